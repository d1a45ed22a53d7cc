"""Facts of whole source texts on small texts of their own."""

from quarryframe.operators import facts


def _files(spark, *rows):
    return spark.createDataFrame([("g", "r", p, c, 1) for p, c in rows], "generation_id string, repo_id string, path string, content string, line int")


def _got(df):
    return {(r.target, r.predicate): (round(r.confidence, 2), r.times) for r in df.collect()}


def test_calls(spark):
    f = _files(spark, ("a.ts", "export function load(x) { if (x) { helper(x); } return other(nested(1)); }\n// gone(1)\nconst s = 'text(2)'; new Thing(3); obj.method(4);\n"), ("B.java", "class B {\n  public List<String> names(int a) { return all(a); }\n}\n"), ("n.ts", None), ("x.py", "f(1)"))
    assert {t for t, _ in _got(facts.calls(f))} == {"helper", "other", "nested", "all"}


def test_http_calls_and_micro_frontends(spark):
    f = _files(spark, ("a.ts", "fetch(\n  '/api/a');\naxios.post(\"/api/b\", x);\nfetch(url);\nregisterApplication({ name: 'cart', app });\n"))
    assert _got(facts.http_calls(f)) == {("/api/a", "INVOKES_API"): (0.95, 1), ("GET /api/a", "INVOKES_API"): (0.95, 1), ("/api/b", "INVOKES_API"): (0.95, 1), ("POST /api/b", "INVOKES_API"): (0.95, 1), ("nonliteral_http_url", "COVERAGE_GAP"): (0.0, 1), ("cart", "REGISTERS_MICROFRONTEND"): (0.85, 1)}


def test_annotations(spark):
    f = _files(spark, ("A.java", '@KafkaListener(\n  topics = "orders")\nvoid a() {}\n@EventListener\nvoid b() {}\n@Value("${a.b:1} ${c}") String v;\n@JmsListener(destination = QUEUE)\nvoid c() {}\n@FeignClient(name = "tax")\ninterface T {}\n'))
    assert _got(facts.annotations(f)) == {("orders", "CONSUMES_TOPIC"): (0.95, 1), ("orders", "CONSUMES_EVENT"): (0.9, 1), ("a.b", "REFERENCES_CONFIGURATION"): (0.95, 1), ("dynamic_jmslistener", "COVERAGE_GAP"): (0.0, 1), ("tax", "DEPENDS_ON_EXTERNAL"): (0.95, 1)}


def test_messages(spark):
    f = _files(spark, ("A.java", 'kafkaTemplate.send("paid", x); jmsTemplate.convertAndSend(\n  queue, x); events.publishEvent(new Paid(1)); events.publishEvent(old); restTemplate.getForObject("/tax", T.class); // jmsTemplate.send("no", 1)\n'))
    assert _got(facts.messages(f)) == {("paid", "PRODUCES_TOPIC"): (0.95, 1), ("paid", "EMITS_EVENT"): (0.9, 1), ("computed_message_destination", "COVERAGE_GAP"): (0.0, 1), ("Paid", "PUBLISHES_EVENT"): (0.95, 1), ("Paid", "EMITS_EVENT"): (0.82, 1), ("/tax", "INVOKES_API"): (0.9, 1), ("GET /tax", "INVOKES_API"): (0.9, 1)}


def test_effective_routes(spark):
    f = _files(spark, ("A.java", '@RestController\n@RequestMapping("/api/")\n@Tag(name = "x")\npublic class A {\n  @GetMapping("/one/")\n  void a() {}\n  @RequestMapping(\n    path = "two")\n  void b() {}\n  @PostMapping\n  void c() {}\n}\n'), ("B.kt", 'class B {\n @PutMapping("/p") fun p() {}\n}\n'))
    assert {t for t, _ in _got(facts.effective_routes(f))} == {"GET /api/one", "REQUEST /api/two", "PUT /p"}


def test_guards():
    text = "if (a > 0) {\n  if (b) throw new E();\n  log.info('x (');\n} else {\n  fetch('/u');\n}\nif (c) { y(); }\nthrow new F();\n"
    assert facts.guarded(text) == [(2, "b"), (3, "a > 0"), (5, "a > 0")]
    assert facts.guarded("") == []


def test_positions(spark):
    f = _files(spark, ("a.py", "é = 1\nx = 'ü' + y\n"))
    spans = spark.createDataFrame([("g", "a.py", 0), ("g", "a.py", 7), ("g", "a.py", 13), ("g", "a.py", 99)], "generation_id string, path string, start_byte long")
    assert sorted((r.start_byte, r.line, r.column) for r in facts.positions(f, spans).collect()) == [(0, 1, 1), (7, 2, 1), (13, 2, 7)]
