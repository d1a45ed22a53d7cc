"""Long exact spans shared between records, by parsing texts relative to an index of reference blocks.

Every text is cut into reference blocks of ``K`` characters at content-defined anchors: in each run of ``W`` block starts the
one with the least hash is an anchor, so any run of ``K + W - 1`` = 300 characters holds at least one, and the same one
wherever it appears. Blocks are indexed by hash. A text is then parsed against the blocks of all other texts: at an indexed
block the factor is extended greedily in both directions as long as both texts agree, blocks inside the factor are skipped,
and factors of at least ``MIN_SPAN`` characters, compared character by character up to their boundaries, are shared spans.

Identical contents are parsed once, as one class. Where a block lies in few classes (``HOT_BLOCK``), what lies around its places is
compared; a shared run of 300 around a block reaches no further, so texts themselves needn't meet (but for periodic text, which is
aligned in every way). A block in more classes is replaced by the 300-character runs around it (``_runs``), told apart by digests of
128 bits, so that only classes that do share a run meet; what still meets there are cases.

Defined results: null texts and texts under the least length share nothing; of a record delivered several times the last
content holds (the greater one at equal times; a row without content never replaces one with content); ties and repeated
text inside one record make no span by themselves; empty tables give no rows; texts of any length are parsed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Least length of a shared span.
MIN_SPAN = 300
#: Length of an indexed block.
K = 150
#: A block in more content classes than this is looked up by whole runs.
HOT_BLOCK = 40

_M = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Hasher:
    """Hashes of all K-character blocks of a text, by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def blocks(self, codes: np.ndarray, k: int) -> np.ndarray:
        n = len(codes)
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up, self.down = _powers(size, _M), _powers(size, _M_INV)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((codes + np.uint64(0x51ED2701)) * self.down[:n], out=s[1:], dtype=np.uint64)
        h = (s[k:] - s[: n + 1 - k]) * self.up[: n + 1 - k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values: block-wise minima from the left and from the right."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:n] = x
    grid = pad.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(text: str, hasher: _Hasher, k: int = K, span: int = MIN_SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last positions and hashes of the anchor blocks; of equal hashes in a window the first position wins."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    w, part = span - k + 1, 1 << 20
    found, hashes = [], []
    for lo in range(0, max(1, len(codes) - span + 1), part):
        piece = codes[lo : lo + part + span - 1]
        h = hasher.blocks(piece, k)
        ranked = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
        at = np.unique(_window_min(ranked, w) & np.uint64((1 << 22) - 1)).astype(np.int64)
        found.append(at + lo)
        hashes.append(h[at])
    pos, h = np.concatenate(found), np.concatenate(hashes)
    if len(found) > 1:
        pos, first = np.unique(pos, return_index=True)
        h = h[first]
    # in periodic text the same block follows itself closely; such a chain is one row, and _periodic aligns it in every way
    order = np.lexsort((pos, h))
    p, g = pos[order], h[order]
    starts = np.ones(len(p) + 1, dtype=bool)
    starts[1:-1] = (g[1:] != g[:-1]) | (p[1:] - p[:-1] > k // 2)
    return p[starts[:-1]], p[starts[1:]], g[starts[:-1]]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = _Hasher()
    for b in batches:
        keys, pos, last, hashes = [], [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q, h = anchors(text, hasher)
            keys.extend([key] * len(p))
            pos.append(p)
            last.append(q)
            hashes.append(h)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(keys, pa.binary()), *[pa.array(np.concatenate(x).astype(np.int32)) for x in (pos, last)]], ["h", "c", "p", "q"])


def _same(a: str, b: str, i: int, j: int) -> int:
    """Length of the common run of a from i and b from j, by doubling steps."""
    n, step = min(len(a) - i, len(b) - j), 256
    done = 0
    while done < n:
        m = min(step, n - done)
        if a[i + done : i + done + m] == b[j + done : j + done + m]:
            done, step = done + m, step * 2
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
    return done


def _same_back(a: str, b: str, i: int, j: int) -> int:
    """Length of the common run that ends before a[i] and b[j]."""
    n, step = min(i, j), 64
    done = 0
    while done < n:
        m = min(step, n - done)
        if a[i - done - m : i - done] == b[j - done - m : j - done]:
            done, step = done + m, step * 2
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
    return done


def _period(block: str) -> int:
    """The least period of a block up to half its length; 0 if there is none."""
    return next((d for d in range(1, len(block) // 2 + 1) if block[d:] == block[:-d]), 0)


def _periodic(a: str, b: str, i: int, j: int, d: int) -> Iterator[tuple[int, int, int]]:
    """(a_start, b_start, length): runs that cover all that the regions of period d around the equal blocks a[i:] and b[j:] share.

    Shifts that differ by whole periods agree as well. At a shift that aligns neither the starts nor the ends of the regions the
    run is exactly their overlap, so the shifts of sufficient overlap are one range, of which steps of at most MIN_SPAN cover
    everything; where starts or ends meet, the run may go on beyond the regions and is extended.
    """
    a0, a1 = i - _same_back(a, a, i, i + d), i + d + _same(a, a, i, i + d)
    b0, b1 = j - _same_back(b, b, j, j + d), j + d + _same(b, b, j, j + d)
    lo, hi = a0 + MIN_SPAN - b1, a1 - b0 - MIN_SPAN
    lo, hi = lo + (i - j - lo) % d, hi - (hi - i + j) % d
    if lo <= hi and min(a1 - a0, b1 - b0) >= MIN_SPAN:
        for s in (*range(lo, hi, MIN_SPAN // d * d), hi):
            at = max(a0, b0 + s)
            yield at, at - s, min(a1, b1 + s) - at
    for s in {a0 - b0, a1 - b1}:
        if (s - i + j) % d == 0:
            at = max(a0, b0 + s)
            back = _same_back(a, b, at, at - s)
            if (length := back + _same(a, b, at, at - s)) >= MIN_SPAN:
                yield at - back, at - s - back, length


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of text a relative to the blocks of text b along one alignment."""
    for b in batches:
        rows: list[tuple] = []
        for ca, cb, shift, at, ta, tb in zip(*(c.to_pylist() for c in b.columns), strict=True):
            end = -1
            for p, chain in sorted((x["p"], x["chain"]) for x in at):
                if p < end and not chain:  # inside the last factor
                    continue
                if ta[p : p + K] != tb[p - shift : p - shift + K]:
                    continue
                if chain and (d := _period(ta[p : p + K])):
                    rows.extend((ca, cb, *x) for x in _periodic(ta, tb, p, p - shift, d))
                    continue
                back = _same_back(ta, tb, p, p - shift)
                on = _same(ta, tb, p, p - shift)
                end = p + on
                if back + on >= MIN_SPAN:
                    rows.append((ca, cb, p - back, p - back - shift, back + on))
        if rows:
            a = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.binary()), pa.array(a[1], pa.binary()), *[pa.array(x, pa.int32()) for x in a[2:]]], ["a", "b", "a_start", "b_start", "length"])


def records(sources: DataFrame) -> DataFrame:
    """(source_id, c): each record's last content as a digest; contents themselves aren't moved."""
    rows = sources.where(F.length("content") >= MIN_SPAN).select("source_id", F.struct("ingested_at", F.substring(F.unhex(F.sha2("content", 256)), 1, 16).alias("c")).alias("v"))
    return rows.where("source_id is not null").groupBy("source_id").agg(F.max("v").alias("v")).select("source_id", F.col("v.c").alias("c"))


def _contents(sources: DataFrame) -> DataFrame:
    return sources.where(F.length("content") >= MIN_SPAN).select(F.substring(F.unhex(F.sha2("content", 256)), 1, 16).alias("c"), "content")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies around each block as far as a run of MIN_SPAN with the block in it can reach."""
    for b in batches:
        rows: list[tuple] = []
        for c, at, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows.extend((x["h"], c, x["p"], text[max(0, x["p"] - MIN_SPAN + K) : x["p"] + MIN_SPAN]) for x in at)
        if rows:
            h, c, p, near = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.binary()), pa.array(p, pa.int32()), pa.array(near, pa.string())], ["h", "c", "p", "near"])


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors around one block of the texts that hold it: both sides are compared character by character up to their boundaries."""
    names = ["a", "b", "a_start", "b_start", "length"]
    for b in batches:
        rows: list[tuple] = []
        for places in b.column(0).to_pylist():
            places.sort(key=lambda x: (x["c"], x["p"]))
            for i, x in enumerate(places):
                ta, at = x["near"], min(x["p"], MIN_SPAN - K)
                for y in places[i + 1 :]:
                    if x["c"] == y["c"]:
                        continue
                    tb, bt = y["near"], min(y["p"], MIN_SPAN - K)
                    if ta[at : at + K] != tb[bt : bt + K]:
                        continue
                    back, on = _same_back(ta, tb, at, bt), _same(ta, tb, at, bt)
                    if back + on >= MIN_SPAN:
                        rows.append((x["c"], y["c"], x["p"] - back, y["p"] - back, back + on))
        if rows:
            a = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.binary()), pa.array(a[1], pa.binary()), *[pa.array(x, pa.int32()) for x in a[2:]]], names)


_SPAN = "a binary, b binary, a_start int, b_start int, length int"


def _index_of(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks of few texts, blocks of many texts, one text per class); a block in one class only is in neither."""
    texts = _contents(sources)
    blocks = cut(texts.mapInArrow(_index, "h long, c binary, p int, q int").distinct())
    by_hash = blocks.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.col("q") > F.col("p")).alias("chain")).where("lo <> hi").select("h", "n", "chain")
    shared = cut(blocks.join(by_hash, "h"))
    one_text = texts.groupBy("c").agg(F.first("content").alias("content"))
    return shared.where(F.col("n") <= HOT_BLOCK), shared.where(F.col("n") > HOT_BLOCK), one_text


def _few(some: DataFrame, one_text: DataFrame) -> DataFrame:
    """(a, b, a_start, b_start, length): factors at blocks that few texts hold."""
    plain, chains = some.where("not chain"), some.where("chain")
    # a text goes once to its own blocks; the blocks then meet with what lies around them, not with texts
    at = plain.groupBy("c").agg(F.collect_list(F.struct("h", "p")).alias("at"))
    near = at.join(one_text, "c").select("c", "at", "content").mapInArrow(_near, "h long, c binary, p int, near string")
    found = near.groupBy("h").agg(F.collect_list(F.struct("c", "p", "near")).alias("places")).select("places").mapInArrow(_factors, _SPAN)
    # periodic text is aligned in every way along the texts themselves
    chain = (F.col("q") > F.col("p")).alias("chain")
    a, b = chains.select("h", F.col("c").alias("a"), F.col("p").alias("ap"), chain.alias("ac")), chains.select("h", F.col("c").alias("b"), F.col("p").alias("bp"), chain.alias("bc"))
    meet = a.join(b, "h").where("a < b").groupBy("a", "b", (F.col("ap") - F.col("bp")).alias("shift")).agg(F.collect_set(F.struct(F.col("ap").alias("p"), (F.col("ac") | F.col("bc")).alias("chain"))).alias("at"))
    meet = meet.join(one_text.select(F.col("c").alias("a"), F.col("content").alias("ta")), "a").join(one_text.select(F.col("c").alias("b"), F.col("content").alias("tb")), "b")
    return found.unionByName(meet.select("a", "b", "shift", "at", "ta", "tb").mapInArrow(_parse, _SPAN))


def _runs(hot: DataFrame, one_text: DataFrame) -> DataFrame:
    """(run, c, s, e): every run of MIN_SPAN characters around the given blocks by its digest of 128 bits, if another class has it too;
    s and e bound what it covers. Of a chain, all phases are among the runs around its first and around its last block, and equal
    runs of it cover everything between them."""
    around = lambda lo, hi: F.filter(F.sequence(lo - (MIN_SPAN - K), hi), lambda s: (s >= 0) & (s <= F.length("content") - MIN_SPAN))
    chain = F.col("q") > F.col("p")
    at = F.when(chain, F.array_union(around(F.col("p"), F.col("p") + K // 2), around(F.col("q"), F.col("q")))).otherwise(around(F.col("p"), F.col("p")))
    text = lambda s: F.substring(F.col("content"), s + 1, F.lit(MIN_SPAN))
    run = lambda s: F.struct(s.alias("p"), F.struct(F.xxhash64(text(s)).alias("x"), F.xxhash64(F.lit(1), text(s)).alias("y")).alias("run"))
    rows = hot.join(one_text, "c").select("c", F.when(chain, F.col("p")).otherwise(-1).alias("first"), F.explode(F.transform(at, run)).alias("v"))
    rows = rows.select("v.run", "c", F.col("v.p").alias("p"), F.when(F.col("first") < 0, F.col("v.p")).otherwise(F.col("first")).alias("first"))
    rows = rows.groupBy("run", "c", "first").agg(F.min("p").alias("s"), (F.max("p") + MIN_SPAN).alias("e")).drop("first")
    twice = rows.groupBy("run").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("run")
    return rows.join(twice, "run")


def shared_pairs(sources: DataFrame) -> DataFrame:
    """(source_id_a, source_id_b): records whose contents share a span, each pair once; identical contents are pairs too."""
    own = records(sources)
    a, b = own.select(F.col("c").alias("a"), F.col("source_id").alias("x")), own.select(F.col("c").alias("b"), F.col("source_id").alias("y"))
    some, hot, one_text = _index_of(sources)
    # of the runs that lie in exactly the same classes one is enough
    runs = _runs(hot.select("c", "p", "q"), one_text).select("run", "c").distinct()
    lies = runs.groupBy("run").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("u"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("v"))
    runs = runs.join(lies.groupBy("n", "u", "v").agg(F.min("run").alias("run")).select("run"), "run")
    many = runs.select("run", F.col("c").alias("a")).join(runs.select("run", F.col("c").alias("b")), "run").where("a < b").select("a", "b")
    apart = _few(some, one_text).select("a", "b").unionByName(many).distinct().join(a, "a").join(b, "b").select(F.least("x", "y").alias("source_id_a"), F.greatest("x", "y").alias("source_id_b"))
    copies = a.join(b, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("source_id_a"), F.col("y").alias("source_id_b"))
    return apart.unionByName(copies)


def shared_shares(sources: DataFrame) -> DataFrame:
    """(source_id, chars, shared_chars, share): how much of each record is found elsewhere; records without text have 0 characters and a
    null share. Only last contents count. No pair of records is formed: copies are counted, blocks in many classes mark the runs
    around them, and at most HOT_BLOCK classes meet at any other block."""
    own = records(sources)
    live = own.select("c").distinct()
    sizes = _contents(sources).groupBy("c").agg(F.max(F.length("content")).alias("chars"))
    copies = own.groupBy("c").agg(F.count("*").alias("n"))
    some, hot, one_text = _index_of(sources)
    some, hot = some.join(live, "c", "left_semi"), hot.join(live, "c", "left_semi")
    spans = _few(some, one_text)
    ends = spans.select(F.explode(F.array(*[F.struct(F.col(c).alias("c"), F.col(f"{c}_start").alias("s"), (F.col(f"{c}_start") + F.col("length")).alias("e")) for c in ("a", "b")])).alias("x")).select("x.*")
    ends = ends.unionByName(_runs(hot.select("c", "p", "q"), one_text).select("c", "s", "e"))
    # distinct intervals of one class are bounded by its length; the union is taken in order
    ends = ends.groupBy("c", "s").agg(F.max("e").alias("e")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("xs"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    union = F.aggregate("xs", zero, lambda z, x: F.struct((z["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], z["end"]))).alias("n"), F.greatest(z["end"], x["e"]).alias("end")))
    part = ends.select("c", union["n"].alias("part"))
    per = sizes.join(copies, "c").join(part, "c", "left").select("c", "chars", F.when(F.col("n") > 1, F.col("chars")).otherwise(F.coalesce("part", F.lit(0))).alias("shared_chars"))
    every = sources.where("source_id is not null").groupBy("source_id").agg(F.max_by(F.coalesce(F.length("content"), F.lit(0)), F.struct(F.col("content").isNotNull(), "ingested_at")).alias("all_chars"))
    out = every.join(own, "source_id", "left").join(per, "c", "left")
    chars = F.coalesce("chars", "all_chars", F.lit(0))
    return out.select("source_id", chars.cast("long").alias("chars"), F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"), F.round(F.coalesce("shared_chars", F.lit(0)) / F.when(chars > 0, chars), 6).alias("share"))
