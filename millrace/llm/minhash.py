"""Near-duplicate texts by b-bit MinHash.

A document's set is its distinct five-word shingles. In one pass over the texts each document gets the minima of a family
of hashes: groups of minima make band keys, and the low bits of all of them are packed into a few 64-bit numbers.
Documents of one set become one class. Within the buckets of classes that share a band key, pairs whose packed bits,
corrected for chance agreement, let them reach the threshold put classes into one family; a task returns the least member
for each class, never pairs. So whatever may link is in one family. Families' texts are then brought together, small ones
many to a task, large ones in blocks of bounded size, and full sets confirm the links there: again a task returns stars.
A large family first meets its first block, block by block; then only what is still outside its largest component meets
the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.texts import map_texts, source
from millrace.operators.components import connected_components
from millrace.storage import discard, written

#: Words of a shingle.
WORDS = 5
#: A pair at the threshold is missed by all bands once in so many times, and all bands together hold at most so many minima.
MISSED, BANDED = 80_000, 150
#: Minima of a signature, the bands' first; low bits kept of each, and 64-bit numbers that hold them.
MINIMA, BITS = 384, 4
PACKED = MINIMA * BITS // 64
#: A candidate may fall short of the threshold by so many standard deviations of the estimate.
SLACK = 5.0
#: Bits, as a power of two, of the filter that finds candidates' texts: 4 MB, whatever the input.
FILTER_BITS = 25
#: Classes of a block of a large family at most, and its shingles; a task holds two blocks. Signatures of a task's buckets.
BLOCK, BLOCK_SHINGLES, TASK_SIGNATURES = 1024, 2**19, 16_384
#: Hashes computed at a time.
TILE = 32_768
#: Words whose hash a worker remembers.
MEMO = 200_000

_MULTIPLY = np.array([int.from_bytes(xxhash.xxh3_128_digest(f"minhash {k}".encode())[:8], "little") | 1 for k in range(MINIMA)], dtype=np.uint64)
_STEP = [np.uint64(int.from_bytes(xxhash.xxh3_128_digest(f"shingle {k}".encode())[:8], "little") | 1) for k in range(WORDS)]


class _Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def banding(percent: int) -> tuple[int, int]:
    """Bands and minima of each for a threshold: as many minima a band as BANDED allows, and so many bands that MISSED holds."""
    for rows in range(BANDED, 0, -1):
        hit = (percent / 100) ** rows
        bands = math.ceil(-math.log(MISSED) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= BANDED:
            return bands, rows
    raise ValueError(f"no bands for a threshold of {percent} percent")


#: Of the threshold that op4 has.
BANDS, ROWS = banding(85)


def shingle_hashes(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words, of all its words; none without words."""
    # A-Z only, and the split takes the space and the bytes 9 to 13.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], dtype=np.uint64)
    n = len(h) - WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        total += _mixed(h[k : k + n] * _STEP[k])
    return np.unique(_mixed(total))


def _name(shingles: np.ndarray) -> list[int]:
    """128 bits that stand for a set."""
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of a non-empty set's minima."""
    minima = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[None, at : at + 512]
        # Tiles that stay in a processor's cache.
        step = max(16, TILE // part.shape[1])
        for k in range(0, MINIMA, step):
            x = part * _MULTIPLY[k : k + step, None]
            x ^= x >> np.uint64(32)
            np.minimum(minima[k : k + step], x.min(axis=1), out=minima[k : k + step])
    minima = _mixed(minima)
    raw = minima[: bands * rows].tobytes()
    keys = np.array([xxhash.xxh3_64_intdigest(raw[8 * rows * k : 8 * rows * (k + 1)], seed=k) for k in range(bands)], dtype=np.uint64)
    low = (minima & np.uint64((1 << BITS) - 1)).reshape(PACKED, -1) << np.arange(0, 64, BITS, dtype=np.uint64)
    return keys.view(np.int64), np.bitwise_or.reduce(low, axis=1)


def _signed(bands: int, rows: int):
    hashes = _Hashes()

    def run(texts: list[str]) -> dict:
        out: dict[str, list] = {"n": [], "hi": [], "lo": [], "keys": [], "packed": []}
        for text in texts:
            s = shingle_hashes(text, hashes)
            row = [len(s), None, None, None, None]
            if len(s):
                row[1:3] = _name(s)
                keys, packed = signature(s, bands, rows)
                row[3:] = keys, packed.tobytes()
            for column, x in zip(out.values(), row):
                column.append(x)
        return out

    return run



def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (the last axis): equal fields counted by bits, less those equal by chance."""
    x = a ^ b
    shift = 1
    while shift < BITS:
        x = x | (x >> np.uint64(shift))
        shift *= 2
    differ = np.bitwise_count(x & np.uint64(int("1" * (64 // BITS), 1 << BITS))).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate that a pair at the threshold stays below less than once in three million."""
    least, chance = percent / 100, 2.0**-BITS
    agree = least + (1 - least) * chance
    return least - SLACK * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def _may_link(n: np.ndarray, packed: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with these signatures can reach the threshold."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (estimate(packed, other) >= least_estimate(percent))


def _merged(label: np.ndarray, i: int, hit: np.ndarray) -> None:
    """Give i, those hit and all that have their labels the least of these."""
    old = np.unique(np.append(label[hit], label[i]))
    label[np.isin(label, old)] = old[0]


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint64).reshape(-1, PACKED)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    if len(keys):
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        yield from zip(cuts, cuts[1:])


_STARS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(ids: list[np.ndarray], least: list[np.ndarray]) -> pa.Table:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, least))
    some = a != b
    return pa.Table.from_arrays([pa.array(a[some], pa.int64()), pa.array(b[some], pa.int64())], schema=_STARS)


def _families(table: pa.Table, percent: int) -> pa.Table:
    """Of whole buckets (key, hi, n, packed): a class and the least of those that pairs which may link lead it to."""
    order = np.argsort(table.column("key").to_numpy(), kind="stable")
    key, hi, n, packed = (x[order] for x in (table.column("key").to_numpy(), table.column("hi").to_numpy(), table.column("n").to_numpy(), _signatures(table)))
    ids, least, pairs = [], [], []
    for lo, to in _runs(key):
        if to - lo == 2:
            pairs.append(lo)
            continue
        label = np.arange(to - lo)
        for i in range(to - lo - 1):
            others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            hit = others[_may_link(n[lo + i], packed[lo + i], n[lo + others], packed[lo + others], percent)]
            if len(hit):
                _merged(label, i, hit)
        ids.append(hi[lo:to]), least.append(hi[lo + label])
    if pairs:
        first = np.array(pairs)
        ok = first[_may_link(n[first], packed[first], n[first + 1], packed[first + 1], percent)]
        ids.append(hi[ok + 1]), least.append(hi[ok])
    return _stars(ids, least)


def _confirm(table: pa.Table, percent: int) -> pa.Table:
    """Of a task's classes: a class's node and the least one that links of full sets lead it to.

    Columns fam, side, hi, lo, rep, c, n, packed, text. Classes of a family meet: those of side 0 all others of side 0, those
    of side 1 those of side 2. Classes of one component c needn't. Rows whose text isn't their class's are other texts of a
    repeated id, and rows that repeat a class add nothing.
    """
    hashes = _Hashes()
    sets = [shingle_hashes(t, hashes) for t in table.column("text").to_pylist()]
    fam, side, hi, lo, rep, c, n = (table.column(x).to_numpy() for x in ("fam", "side", "hi", "lo", "rep", "c", "n"))
    packed, seen, own = _signatures(table), set(), []
    for k, s in enumerate(sets):
        name = (int(fam[k]), int(side[k]), int(hi[k]), int(lo[k]), int(rep[k]))
        if name not in seen and len(s) and _name(s) == [name[2], name[3]]:
            seen.add(name), own.append(k)
    own = np.array(own, dtype=np.int64)
    own = own[np.lexsort((rep[own], side[own], fam[own]))]
    ids, least = [], []
    for at, to in _runs(fam[own]):
        k = own[at:to]
        label = np.unique(c[k], return_inverse=True)[1].astype(np.int64)
        before = label.copy()
        # The family's shingles as small numbers, so that a set is looked up by marking its own.
        flat = np.unique(np.concatenate([sets[x] for x in k]), return_inverse=True)[1]
        ends = np.cumsum([len(sets[x]) for x in k])
        parts = [flat[e - len(sets[x]) : e] for x, e in zip(k, ends.tolist())]
        marked = np.zeros(int(flat.max()) + 1, dtype=np.int64)
        two = np.flatnonzero(side[k] == 2)
        for i in np.flatnonzero(side[k] < 2).tolist():
            others = np.arange(i + 1, len(k)) if side[k[i]] == 0 else two
            others = others[label[others] != label[i]]
            others = others[_may_link(n[k[i]], packed[k[i]], n[k[others]], packed[k[others]], percent)]
            if not len(others):
                continue
            marked[parts[i]] = 1
            many = n[k[others]]
            both = np.add.reduceat(marked[np.concatenate([parts[j] for j in others])], np.cumsum(many) - many)
            marked[parts[i]] = 0
            hit = others[100 * both >= percent * (len(parts[i]) + many - both)]
            if len(hit):
                _merged(label, i, hit)
        # A star for each set of components that came together: each component's members point at the least of all.
        for x in np.flatnonzero(np.bincount(label, minlength=1) > 1).tolist():
            member = k[label == x]
            if len(np.unique(before[label == x])) > 1:
                ids.append(rep[member]), least.append(np.full(len(member), rep[member].min()))
    return _stars(ids, least)


def _some_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is in `ids`, and a few others, without moving any.

    A bitmap of fixed size, 2 ** FILTER_BITS bits over hashes of the ids, is broadcast. If the ids outgrow it more rows come
    through; whoever joins them finds the same.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**FILTER_BITS))
    part, bit = F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(2**15 - 1))
    maps = ids.select(part, bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.expr("bit div 8 + 1").cast("int"), 1)), 16, 10).cast("int")
    some = docs.withColumn("part", F.shiftright(place, 15)).withColumn("bit", bit).join(F.broadcast(maps), "part")
    some = some.where(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return some.drop("part", "bit", "map")


def _confirmed(rows: DataFrame, piece: list[str], percent: int, name: str) -> DataFrame:
    """Stars (a, b) of the links that full sets confirm, the rows of a piece in one task."""
    columns = ["fam", "side", "hi", "lo", "rep", "c", "n", "packed", "text"]
    work = rows.select(*[x for x in piece if x not in columns], *columns).groupBy(*piece).applyInArrow(lambda t: _confirm(t, percent), "a long, b long")
    return written(work, name)


def _bins(total: int, each: int) -> int:
    return max(1, -(-total // each))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Return ``(doc_id, n_shingles, component_id, kept)`` for every row of `docs`.

    Words are runs of other than space and the characters 9 to 13, with A-Z lower-cased. Two documents link if
    ``100 * |both| >= percent * |either|`` over their sets of five-word shingles (all words, if fewer). component_id is
    the smallest id that links lead to, kept whether it is the row's own. Null, empty and blank texts have an empty set and
    link with nothing. Equal sets are one class and never compared, so copies cost no more than a row each. A row without
    an id counts its shingles but links with nothing and has a null component, kept false. Rows that repeat an id are one
    document: their classes, if their texts differ, are in one component. Extra columns are left out; an empty table gives no
    rows.

    What may be missed: a pair exactly at the threshold shares no band once in MISSED (80,000) times, one above it less
    often (at 0.90 for a threshold of 0.85 below once in 10 ** 8), and its estimate falls short of the slack once in three
    million. A missed pair only matters if no other link joins the two. Every confirmed link is exact.
    """
    docs = source(docs, id_col, text_col)
    signed = written(map_texts(docs, partial(_signed, *banding(percent)), "n long, hi long, lo long, keys array<long>, packed binary"), "signed")
    named = signed.where("hi is not null and doc_id is not null")
    # What a class has follows from its set, so any row's will do.
    any_ = [F.first(x).alias(x) for x in ("n", "keys", "packed")]
    classes = written(named.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), *any_), "classes")
    sketch = classes.select("hi", "n", "packed")

    # Buckets of two classes or more, one of those that have the same members. A class goes by its first 64 bits here: two that
    # shared them would only share a family.
    members = classes.select("hi", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("hi")).alias("print"), F.min("hi").alias("head")).where("many > 1")
    buckets = written(buckets.groupBy("many", "print").agg(F.min(F.struct("key", "head")).alias("x")).select("x.*", "many"), "buckets")
    members = written(members.join(buckets, "key").select("key", "hi", "head", "many"), "members")
    small = members.where(F.col("many") <= BLOCK)
    # A bucket too large for a task is one family as it is, which costs comparisons later but loses nothing.
    whole = members.where((F.col("many") > BLOCK) & (F.col("hi") != F.col("head"))).select(F.col("hi").alias("a"), F.col("head").alias("b"))
    bins = _bins(buckets.where(F.col("many") <= BLOCK).agg(F.sum("many")).first()[0] or 0, TASK_SIGNATURES)
    dealt = small.select("key", "hi", F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin")).join(sketch, "hi").select("bin", "key", "hi", "n", "packed")
    near = written(dealt.groupBy("bin").applyInArrow(lambda t: _families(t, percent), "a long, b long").unionByName(whole), "near")
    family = connected_components(near, "a", "b").select(F.col("id").alias("hi"), F.col("component").alias("fam"))
    family = written(family.join(classes.drop("keys"), "hi"), "family")

    # Families with their texts. `blocks`: into how many a family is cut.
    sizes = written(family.groupBy("fam").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"), F.sum("n").alias("shingles")), "sizes")
    asked = written(family.join(sizes.select("fam", "blocks"), "fam"), "asked")
    texts = _some_of(docs, asked.select(F.col("rep").alias("doc_id")))
    texts = written(asked.join(texts, asked["rep"] == texts["doc_id"]).drop("doc_id"), "texts")
    totals = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("shingles"))), F.max("blocks")).first()
    alone = texts.where("blocks = 1").withColumns({"c": F.col("rep"), "side": F.lit(0), "bin": F.pmod(F.xxhash64("fam"), F.lit(_bins(totals[0] or 0, BLOCK_SHINGLES)))})
    links = [_confirmed(alone, ["bin"], percent, "links")]
    if (totals[1] or 0) > 1:
        links += _large(texts.where("blocks > 1"), percent)

    # Classes of one document are one.
    several = named.groupBy("doc_id").agg(F.min("hi").alias("h"), F.max("hi").alias("h2"), F.min("lo").alias("l"), F.max("lo").alias("l2")).where("h != h2 or l != l2").select("doc_id")
    shared = named.select("doc_id", "hi", "lo").join(several, "doc_id", "left_semi").join(classes.select("hi", "lo", "rep"), ["hi", "lo"])
    links.append(shared.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    component = connected_components(edges, "a", "b").withColumnRenamed("id", "rep")
    by_class = written(classes.select("hi", "lo", "rep").join(component, "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id")), "answers")
    discard(classes, buckets, members, near, family, sizes, asked, texts, *links)
    out = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("hi")).alias("hi"), "lo").join(by_class, ["hi", "lo"], "left")
    found = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(False)).alias("kept"))


def _large(texts: DataFrame, percent: int) -> list[DataFrame]:
    """Stars of the links in families of several blocks."""
    # Every block meets the first.
    block = F.pmod(F.xxhash64("hi"), F.col("blocks"))
    rows = texts.withColumn("c", F.col("rep")).withColumn("block", block)
    pieces = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = rows.withColumn("piece", F.explode(pieces)).withColumn("side", F.when(F.col("piece") == 0, 0).when(F.col("block") == 0, 1).otherwise(2))
    first = _confirmed(rows, ["fam", "piece"], percent, "links")
    # What is outside a family's largest component meets all that is outside it, and all of that component.
    component = connected_components(first, "a", "b").withColumnRenamed("id", "rep")
    light = texts.select("fam", "rep", "n").distinct().join(component, "rep", "left").select("fam", "rep", "n", F.coalesce("component", "rep").alias("c"))
    light = written(light, "light")
    per = light.groupBy("fam", "c").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    cut = lambda k, n: F.greatest(F.lit(1), F.ceil(k / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("long")
    most = per.groupBy("fam").agg(F.max(F.struct("k", "c", "n")).alias("m"), F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum("n").alias("n")).where("parts > 1")
    most = written(most.select("fam", F.col("m.c").alias("most"), cut(F.col("m.k"), F.col("m.n")).alias("inner"), cut(F.col("k") - F.col("m.k"), F.col("n") - F.col("m.n")).alias("outer")), "most")
    rows = texts.join(light.select("fam", "rep", "c").distinct(), ["fam", "rep"]).join(most, "fam")
    outside = F.col("c") != F.col("most")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("hi"), F.when(outside, F.col("outer")).otherwise(F.col("inner"))))
    zero = F.lit(0).cast("long")
    piece = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(side).alias("side"))
    # Pieces (x, y): of two outer blocks, or of the outer block x and the inner block y, numbered on after the outer ones.
    with_outer = F.transform(F.sequence(zero, F.col("outer") - 1), lambda y: F.when(y == F.col("block"), piece(y, y, 0)).when(F.col("block") < y, piece(F.col("block"), y, 1)).otherwise(piece(y, F.col("block"), 2)))
    with_inner = F.transform(F.sequence(F.col("outer"), F.col("outer") + F.col("inner") - 1), lambda y: piece(F.col("block"), y, 1))
    of_inner = F.transform(F.sequence(zero, F.col("outer") - 1), lambda x: piece(x, F.col("outer") + F.col("block"), 2))
    rows = rows.withColumn("p", F.explode(F.when(outside, F.concat(with_outer, with_inner)).otherwise(of_inner))).select("*", "p.*")
    rest = _confirmed(rows, ["fam", "x", "y"], percent, "links")
    discard(light, most)
    return [first, rest]


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP4 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS x FROM d),
r AS (SELECT x, min(doc_id) AS rep, len(x) AS n FROM s WHERE len(x) > 0 GROUP BY x),
h AS (SELECT rep, n, unnest(x) AS sh FROM r),
b AS (SELECT p.rep AS a, q.rep AS b, p.n AS na, q.n AS nb, count(*) AS shared FROM h p JOIN h q ON p.sh = q.sh AND p.rep < q.rep GROUP BY ALL),
e AS (SELECT a, b FROM b WHERE 100 * shared >= 85 * (na + nb - shared)),
c(id, low) AS (SELECT rep, rep FROM r UNION SELECT f.y, c.low FROM c JOIN (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e) f ON f.x = c.id AND c.low < f.y),
k AS (SELECT id, min(low) AS component_id FROM c GROUP BY id)
SELECT doc_id, len(s.x)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM s LEFT JOIN r ON r.x = s.x LEFT JOIN k ON k.id = r.rep
"""
