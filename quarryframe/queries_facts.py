"""Queries of the facts told by whole source texts, and the SQL that says the same, written by hand."""

from __future__ import annotations

from .operators import facts
from .queries_core import _FILES, _LANG, Tables, W

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STR = r'''"[^"\\\n]*(?:\\.[^"\\\n]*)*"|''[^''\\\n]*(?:\\.[^''\\\n]*)*''|`[^`]*`'''
_TEXTS = "texts as (select repo_id, path, l lang, regexp_replace(content, '(" + _STR + r")|(?s:/\*.*?\*/)|//[^\n]*', '\1', 'g') t from (select repo_id, path, content, " + _LANG + " l from files where content is not null) where l in ({langs}))"
_UI, _SERVICE = "'typescript', 'tsx', 'javascript', 'jsx'", "'java', 'kotlin'"
_LIT = r"regexp_extract({m}, '[\"''`]([^\"''`\n]*)[\"''`]', 1)"
_OUT = "select repo_id, path, target, predicate, confidence::double confidence, count(*)::bigint times from facts where target <> '' group by all"


@query(
    W(_FILES, _TEXTS.format(langs=f"{_UI}, {_SERVICE}"), "a as (select repo_id, path, regexp_replace(t, '" + _STR + "', '\"\"', 'g') t from texts)",
      r"b as (select repo_id, path, regexp_replace(t, '\n\s*(?:(?:async|static|get|set|override|private|public|protected)\s+)*[A-Za-z_$][\w$]*\s*\([^()]*\)\s*(?::[^={};\n]+)?\{', chr(10) || '{', 'g') t from a)",
      r"c as (select repo_id, path, regexp_replace(regexp_replace(t, '[\w\]?>][>\]]\s+[A-Za-z_$][\w$]*\s*\(', '>(', 'g'), '\(', '( ', 'g') t from b)",
      r"m as (select repo_id, path, unnest(regexp_extract_all(t, '[^\w$.@]((?:[\w$]+\s+)?[A-Za-z_$][\w$]*)\s*\(', 1)) m from c)",
      r"""facts as (select repo_id, path, regexp_extract(m, '([A-Za-z_$][\w$]*)$', 1) target, 'CALLS' predicate, 0.8 confidence from m where regexp_extract(m, '^([\w$]+)\s', 1) in ('', 'return', 'else', 'throw', 'await', 'yield', 'case', 'in', 'of', 'do', 'when')
      and regexp_extract(m, '([A-Za-z_$][\w$]*)$', 1) not in ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'typeof', 'super', 'this', 'constructor', 'synchronized', 'await', 'when', 'try', 'new', 'import', 'throw', 'assert', 'yield', 'do', 'else', 'void', 'delete', 'in', 'of', 'case', 'fun'))""") + _OUT)  # fmt: skip
def calls_extract(spark, d):
    """EXT-08: calls of plain names."""
    return facts.calls(Tables(spark, d).files)


@query(
    W(_FILES, _TEXTS.format(langs=_UI),
      r"""asks as (select repo_id, path, unnest(regexp_extract_all(t, '\b(?:fetch|axios\.(?:get|post|put|patch|delete))\s*\(\s*(?:"[^"\n]*"|''[^''\n]*''|`[^`$]*`|[^\s])')) m from texts)""",
      "urls as (select repo_id, path, " + _LIT.format(m="m") + r" url, case when starts_with(m, 'fetch') then 'GET' else upper(regexp_extract(m, '^axios\.(\w+)', 1)) end verb from asks)",
      r"""facts as (select repo_id, path, url target, 'INVOKES_API' predicate, 0.95 confidence from urls union all select repo_id, path, verb || ' ' || url, 'INVOKES_API', 0.95 from urls where url <> '' union all select repo_id, path, 'nonliteral_http_url', 'COVERAGE_GAP', 0.0 from urls where url = ''
      union all select repo_id, path, unnest(regexp_extract_all(t, '\bregisterApplication\s*\([^()"''`]*["''`]([^"''`\n]+)["''`]', 1)), 'REGISTERS_MICROFRONTEND', 0.85 from texts)""") + _OUT)  # fmt: skip
def http_calls_extract(spark, d):
    """EXT-04, EXT-05: requests of user interfaces, twice each, their gaps, and micro-frontends."""
    return facts.http_calls(Tables(spark, d).files)


_MAPPINGS = "RequestMapping|GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping"


@query(
    W(_FILES, _TEXTS.format(langs=_SERVICE),
      r"m as (select repo_id, path, unnest(regexp_extract_all(t, '@(?:" + _MAPPINGS + r"|JmsListener|KafkaListener|EventListener|FeignClient|Value|ConfigurationProperties|Table)\b(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?')) m from texts)",
      r"n as (select repo_id, path, regexp_extract(m, '^@(\w+)', 1) nm, " + _LIT.format(m="m") + " lit from m)",
      r"""facts as (select repo_id, path, lit target, 'DECLARES_ENDPOINT' predicate, 0.9 confidence from n where nm like '%Mapping' union all select repo_id, path, lit, 'LISTENS_QUEUE', 0.95 from n where nm = 'JmsListener' union all select repo_id, path, lit, 'CONSUMES_TOPIC', 0.95 from n where nm = 'KafkaListener'
      union all select repo_id, path, lit, 'LISTENS_EVENT', 0.95 from n where nm = 'EventListener' union all select repo_id, path, lit, 'CONSUMES_EVENT', 0.9 from n where nm in ('JmsListener', 'KafkaListener', 'EventListener') union all select repo_id, path, lit, 'DEPENDS_ON_EXTERNAL', 0.95 from n where nm = 'FeignClient'
      union all select repo_id, path, regexp_extract(lit, '\$\{([A-Za-z0-9_.\-]+)', 1), 'REFERENCES_CONFIGURATION', 0.95 from n where nm = 'Value' union all select repo_id, path, lit, 'BINDS_CONFIGURATION', 0.95 from n where nm = 'ConfigurationProperties' union all select repo_id, path, lit, 'MAPS_TABLE', 0.95 from n where nm = 'Table'
      union all select repo_id, path, 'dynamic_' || lower(nm), 'COVERAGE_GAP', 0.0 from n where lit = '' and nm not in ('EventListener', 'FeignClient'))""") + _OUT)  # fmt: skip
def annotations_extract(spark, d):
    """EXT-11, EXT-12: facts of annotations with their twins and gaps, wrapped over lines or not."""
    return facts.annotations(Tables(spark, d).files)


@query(
    W(_FILES, _TEXTS.format(langs=_SERVICE),
      r"s as (select repo_id, path, unnest(regexp_extract_all(t, '\b(?:kafkaTemplate|jmsTemplate)\s*\.\s*(?:convertAndSend|send)\s*\([^()]*')) m from texts)",
      r"v as (select repo_id, path, starts_with(m, 'kafka') k, " + _LIT.format(m="m") + " lit from s)",
      r"e as (select repo_id, path, unnest(regexp_extract_all(t, '\b(?:publishEvent|multicastEvent)\s*\(\s*new\s+([A-Za-z_$][\w$.]*)', 1)) target from texts)",
      r"r as (select repo_id, path, unnest(regexp_extract_all(t, '\b(?:restTemplate|webClient|restClient)\s*\.\s*\w+\s*\([^()]*')) m from texts)",
      r"u as (select repo_id, path, regexp_extract(upper(regexp_extract(m, '\.\s*(\w+)', 1)), '^(GET|POST|PUT|DELETE|PATCH)', 1) verb, " + _LIT.format(m="m") + " url from r)",
      """facts as (select repo_id, path, lit target, case when k then 'PRODUCES_TOPIC' else 'SENDS_QUEUE' end predicate, 0.95 confidence from v union all select repo_id, path, lit, 'EMITS_EVENT', 0.9 from v union all select repo_id, path, 'computed_message_destination', 'COVERAGE_GAP', 0.0 from v where lit = ''
      union all select repo_id, path, target, 'PUBLISHES_EVENT', 0.95 from e union all select repo_id, path, target, 'EMITS_EVENT', 0.82 from e union all select repo_id, path, url, 'INVOKES_API', 0.9 from u union all select repo_id, path, verb || ' ' || url, 'INVOKES_API', 0.9 from u where verb <> '' and url <> '')""") + _OUT)  # fmt: skip
def messages_extract(spark, d):
    """EXT-13, EXT-14: sends, published events and requests of services with their twins and gaps."""
    return facts.messages(Tables(spark, d).files)


_OF_CLASS = r"@RequestMapping\s*\(([^()]*)\)\s*(?:@\w+(?:\s*\([^()]*\))?\s*)*(?:(?:public|protected|private|abstract|final|open|sealed)\s+)*(?:class|interface)\b"


@query(
    W(_FILES, _TEXTS.format(langs=_SERVICE),
      "p as (select repo_id, path, " + _LIT.format(m=f"regexp_extract(t, '{_OF_CLASS}', 1)") + f" prefix, unnest(regexp_extract_all(regexp_replace(t, '{_OF_CLASS}', ' class', 'g'), '" + r"@(?:Request|Get|Post|Put|Patch|Delete)Mapping\s*\([^()]*\)')) m from texts)",
      r"o as (select repo_id, path, prefix, upper(regexp_extract(m, '^@(\w+)Mapping', 1)) verb, " + _LIT.format(m="m") + " own from p)",
      "facts as (select repo_id, path, verb || ' ' || case when prefix = '' then own else '/' || trim(prefix, '/') || '/' || trim(own, '/') end target, 'DECLARES_EFFECTIVE_ENDPOINT' predicate, 0.9 confidence from o where own <> '')") + _OUT)
def effective_routes(spark, d):
    """EXT-15: routes of methods behind the path of their class."""
    return facts.effective_routes(Tables(spark, d).files)


@query()
def guards_extract(spark, d):
    """EXT-16: the innermost condition around each emission, request, message or error (brackets must be matched: no SQL)."""
    return facts.guards(Tables(spark, d).files)


@query(
    W(_FILES, "f as (select generation_id, path, encode(content) b from files where content is not null)",
      "s as (select distinct generation_id, path, name, start_byte from symbols where start_byte is not null)",
      "x as (select s.*, regexp_extract_all(hex(b[1:start_byte]), '..') h from s join f using (generation_id, path) where start_byte between 0 and octet_length(b))") +
    "select generation_id, path, name, start_byte, (len(list_filter(h, lambda y: y = '0A')) + 1)::int as \"line\", (case when list_contains(h, '0A') then len(h) - len(h) + list_position(list_reverse(h), '0A') else len(h) + 1 end)::int as \"column\" from x")
def byte_positions(spark, d):
    """EXT-20: lines and columns of the bytes at which symbols start."""
    t = Tables(spark, d)
    spans = t.symbols.where("start_byte is not null").select("generation_id", "path", "name", "start_byte").distinct()
    return facts.positions(t.files, spans)
