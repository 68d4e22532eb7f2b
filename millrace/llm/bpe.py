"""Byte-pair encoding by a minimal acyclic transducer of frequent words, with exact merges for the rest.

The corpus' words are counted over all documents; the most frequent ones, with the ids they encode to, are compiled into
a minimal acyclic automaton whose arcs carry numbers that add up to a word's place in a table of ids, so that equal
suffixes share their states. It is compiled in one task; the automaton and the tokenizer are files in the shared folder,
which Spark hands to every executor and each worker maps into memory. A word that it lacks is merged exactly, by rank. Words met before are kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.texts import held, let_go, map_texts
from millrace.storage import shared_dir, written

#: The pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the lexicon at most, bytes of a word of it, entries of a worker's memo, and words counted before they are passed on.
LEXICON_WORDS, LEXICON_BYTES, MEMO, COUNTED = 32_768, 48, 400_000, 400_000
#: Classes of frequency for each doubling.
FREQUENCY_CLASSES = 64
#: The rank of a pair that never merges.
NEVER = 1 << 62
#: Marks that are one word after letters.
PUNCTUATION = frozenset(".,;:!?")
#: Bytes of the texts that are encoded together.
GROUP_BYTES = 4_000_000
MAGIC = b"millrace lexicon 1".ljust(32)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Ranks and bytes of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        # The printable stand-ins of bytes: those that print stand for themselves, the others follow from 256.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        stand = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        model = data["model"]
        vocab = model["vocab"]
        added = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.added = added
        self.words: dict[int, bytes] = {i: bytes(stand[c] for c in w) for w, i in vocab.items()}
        self.words.update({i: w.encode() for w, i in added.items()})
        self.byte_id = [0] * 256
        for i, w in self.words.items():
            if len(w) == 1:
                self.byte_id[w[0]] = i
        #: For a pair of ids that merges: its rank, and below that the merged id.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), rank << 32 | vocab[a + b])
        self.byte_ids = np.array(self.byte_id, np.int64)
        pairs = sorted((a << 32 | b, m) for (a, b), m in self.merges.items())
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in pairs], np.int64), np.array([m for _, m in pairs], np.int64)
        self.split_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: again and again the pair of least rank, leftmost first."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > 64:
            return self._merge_long(parts)
        get = self.merges.get
        ranks = [get(ab, NEVER) for ab in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
        return parts

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """`merge` for many words at once, as little-endian 32-bit numbers.

        Words of equal length stand in one matrix; in each round every row that can still merge merges its best pair, so
        the rows that go on keep a common length.
        """
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            if n > 64 or not n:
                for k in at:
                    out[k] = array("I", self.merge(words[k])).tobytes()
                continue
            rows = np.array(at)
            ids = self.byte_ids[np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(-1, n)]
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            while True:
                if ids.shape[1] > 1:
                    i = ranks.argmin(axis=1)
                    best = np.take_along_axis(ranks, i[:, None], 1)[:, 0]
                    ended = best == NEVER
                else:
                    ended = np.ones(len(ids), dtype=bool)
                if ended.any():
                    flat, width = ids[ended].astype("<u4").tobytes(), 4 * ids.shape[1]
                    for j, k in enumerate(rows[ended].tolist()):
                        out[k] = flat[j * width : (j + 1) * width]
                    if ended.all():
                        break
                    on = ~ended
                    rows, ids, ranks, i, best = rows[on], ids[on], ranks[on], i[on], best[on]
                r = np.arange(len(ids))
                ids[r, i] = best & 0xFFFFFFFF
                keep = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, keep + (keep > i[:, None]), 1)
                if ids.shape[1] == 1:
                    continue
                keep = np.arange(ids.shape[1] - 1)
                ranks = np.take_along_axis(ranks, keep + (keep >= i[:, None]), 1)
                for side in (i - 1, i):
                    ok = np.flatnonzero((side >= 0) & (side < ids.shape[1] - 1))
                    ranks[ok, side[ok]] = self._ranks(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, n log n for words of any length."""
        n, get = len(parts), self.merges.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            new = m & 0xFFFFFFFF
            parts[i], parts[j] = new, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if m := get((new, parts[k])):
                    heapq.heappush(heap, (m, i, new, parts[k]))
            if (h := prv[i]) >= 0 and (m := get((parts[h], new))):
                heapq.heappush(heap, (m, h, parts[h], new))
        return [x for x in parts if x >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of `words` as one block of arrays.

    Minimal by incremental construction from sorted words: once a branch can't grow any more, its states are replaced by
    equal ones met before. A state's arcs lie side by side by byte; an arc's number is how many words of its state come
    before those that go through it, so the numbers on a path add up to the word's place among the sorted words.
    """
    sorted_words = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for w in sorted_words:
        common = len(os.path.commonprefix([w, last]))
        while len(path) > common + 1:
            done = path.pop()
            path[-1][1][-1] = (path[-1][1][-1][0], freeze(done))
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        done = path.pop()
        path[-1][1][-1] = (path[-1][1][-1][0], freeze(done))
    root = freeze(path[0])
    count = np.zeros(len(states), dtype=np.int64)
    first, label, to, before = [0], [], [], []
    for s, (final, arcs) in enumerate(states):
        total = int(final)
        for b, t in arcs:
            label.append(b), to.append(t), before.append(total)
            total += int(count[t])
        count[s] = total
        first.append(len(label))
    ids = [words[w] for w in sorted_words]
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) if ids else np.zeros(1, dtype=np.int64)
    arrays = [np.array(first, "<u4"), np.array(label, "<u4"), np.array(to, "<u4"), np.array(before, "<u4"), np.array([f for f, _ in states], "<u4"), at.astype("<u4"), np.array([i for x in ids for i in x], "<u4")]
    head = np.array([root, *map(len, arrays)], "<u4")
    return MAGIC + head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, read in place."""

    def __init__(self, block):
        head = np.frombuffer(block, "<u4", 8, len(MAGIC))
        at, views = len(MAGIC) + 32, []
        for n in head[1:].tolist():
            views.append(np.frombuffer(block, "<u4", n, at))
            at += 4 * n
        self.root = int(head[0])
        self.first, self.label, self.to, self.before, self.final, self.at, self.ids = views
        #: Arcs of the states met so far, read from the mapped arrays when first needed.
        self.arcs: dict[int, dict[int, tuple[int, int]]] = {}

    @classmethod
    def mapped(cls, path: str) -> "Lexicon":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers, or None."""
        state, place, arcs = self.root, 0, self.arcs
        for b in word:
            out = arcs.get(state)
            if out is None:
                lo, hi = int(self.first[state]), int(self.first[state + 1])
                out = arcs[state] = dict(zip(self.label[lo:hi].tolist(), zip(self.to[lo:hi].tolist(), self.before[lo:hi].tolist())))
            arc = out.get(b)
            if arc is None:
                return None
            state = arc[0]
            place += arc[1]
        if not self.final[state]:
            return None
        return self.ids[self.at[place] : self.at[place + 1]].tobytes()


#: Where whitespace runs around a single space, or at the end, a cut at that space would change the words.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_FINDALL = regex.compile(PATTERN).findall


def split_piece(piece: str) -> list[str]:
    """Words of a piece: a space, then no other; the common shapes without the pattern."""
    if piece[1:].isalpha() and piece[0] == " ":
        return [piece]
    if piece[-1:] in PUNCTUATION and piece[:1] == " " and piece[1:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return _FINDALL(piece)


class Encoder:
    """Encodes texts in groups: pieces met before come from a memo, new words from the lexicon, the rest are merged together."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        #: Ids of pieces after a space, and of other words; emptied when full, so a worker's memory is bounded.
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        spelt = [vocabulary.words.get(i, b"") for i in range(max(vocabulary.words) + 1)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.long = np.array([len(w) for w in spelt], np.int64)
        self.start = np.cumsum(self.long) - self.long

    def _resolve(self, raw: list[bytes]) -> list[bytes]:
        """Ids of new words: the lexicon's, or merged together."""
        find = self.lexicon.find
        found = [find(w) if len(w) <= LEXICON_BYTES else None for w in raw]
        rest = [k for k, f in enumerate(found) if f is None]
        for k, merged in zip(rest, self.vocabulary.merge_many([raw[k] for k in rest])):
            found[k] = merged
        return found

    def _learn(self, split: dict[str, list[str]], alone: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of new pieces and words. split: pieces with their words; alone: pieces that are one word of letters."""
        spaced, loose = dict.fromkeys(alone), {}
        for ws in split.values():
            for w in ws:
                if w[0] == " ":
                    if w[1:] not in self.pieces:
                        spaced[w[1:]] = None
                elif w not in self.words:
                    loose[w] = None
        raw = [b" " + p.encode("utf-8", "surrogatepass") for p in spaced] + [w.encode("utf-8", "surrogatepass") for w in loose]
        ids = self._resolve(raw)
        spaced, loose = dict(zip(spaced, ids)), dict(zip(loose, ids[len(spaced) :]))
        word = lambda w: (spaced.get(w[1:]) or self.pieces[w[1:]]) if w[0] == " " else (loose.get(w) or self.words[w])
        made = {p: b"".join([word(w) for w in ws]) for p, ws in split.items()}
        return spaced | made, loose

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers; strings of added tokens count as these tokens."""
        added, parts, known = self.vocabulary.split_added, self.vocabulary.added, self.pieces.get
        plan: list[list[tuple]] = []
        new: dict[str, None] = {}
        other: list[list[str]] = []
        for text in texts:
            steps: list[tuple] = []
            for k, x in enumerate(added.split(text) if added and any(a in text for a in parts) else [text]):
                if k % 2:
                    steps.append((None, [array("I", [parts[x]]).tobytes()]))
                elif x and _UNSAFE.search(x):
                    other.append(_FINDALL(x))
                    steps.append((other[-1], None))
                elif x:
                    # Each space starts a new word here, so that the pieces between can be looked up whole.
                    first, *pieces = x.split(" ")
                    if first:
                        other.append(_FINDALL(first))
                        steps.append((other[-1], None))
                    ids = list(map(known, pieces))
                    if None in ids:
                        new.update(dict.fromkeys([p for p, i in zip(pieces, ids) if i is None]))
                    steps.append((pieces, ids))
            plan.append(steps)
        alone = [p for p in new if p.isalpha()]
        split = {p: split_piece(" " + p) for p in new if not p.isalpha()}
        # The other words stand as pieces of their own, marked apart by a key that no piece has.
        split.update({" " + str(k): ws for k, ws in enumerate(other)})
        fresh, loose = self._learn(split, alone)
        runs = iter([fresh.pop(" " + str(k)) for k in range(len(other))])
        out = []
        for steps in plan:
            whole = []
            for pieces, ids in steps:
                if ids is None:
                    whole.append(next(runs))
                elif None in ids:
                    whole.append(b"".join([fresh[p] if i is None else i for p, i in zip(pieces, ids)]))
                else:
                    whole.append(b"".join(ids))
            out.append(b"".join(whole))
        for memo, more in ((self.pieces, fresh), (self.words, loose)):
            if len(memo) + len(more) > MEMO:
                memo.clear()
            memo.update(more if max(map(len, more), default=0) <= 64 else {w: i for w, i in more.items() if len(w) <= 64})
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that aren't UTF-8 become the replacement character."""
        i = np.frombuffer(ids, "<u4")
        long = self.long[i]
        shift = self.start[i] - (np.cumsum(long) - long)
        return self.spelt[np.repeat(shift, long) + np.arange(int(long.sum()))].tobytes().decode("utf-8", "replace")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between white space and their counts in a partition, in parts of bounded size."""
    let_go()
    pieces: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(pieces.values(), pa.int64())], ["piece", "n"])
        pieces.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            pieces.update(text.split())
            if len(pieces) >= COUNTED:
                yield flush()
    if pieces:
        yield flush()


def frequent_pieces(docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """``(piece, n)``: at most `words` of the pieces that all texts hold twice or more, the most frequent, whole classes of
    about equal frequency at a time. Only the classes' sizes reach the driver, a few thousand numbers at any size."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).where("text != ''").mapInArrow(_counted, "piece string, n long")
    counts = counts.where(F.octet_length("piece") < LEXICON_BYTES).groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts.withColumn("class", F.floor(F.log2("n") * FREQUENCY_CLASSES).cast("int")), "pieces")
    sizes = sorted(((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 30, 0
    for k, n in sizes:
        if held + n > words:
            break
        least, held = k, held + n
    return counts.where(F.col("class") >= least).select("piece", "n")


def publish(spark: SparkSession, block: bytes, kind: str) -> str:
    """Write a file to the shared folder and have Spark hand it to every executor; the file's name, by content."""
    name = f"{kind}-{hashlib.sha256(block).hexdigest()[:16]}.bin"
    uri = f"{shared_dir(spark).rstrip('/')}/millrace/{name}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(f"{uri}.{os.getpid()}")
        out = fs.create(part, True)
        try:
            out.write(bytearray(block))
        finally:
            out.close()
        if not fs.rename(part, path) and not fs.exists(path):
            raise OSError(f"can't write {uri}")
        fs.deleteOnExit(path)
    if name not in (f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(str(fs.makeQualified(path).toString()))
    return name


def _encoder(lexicon: str, tokenizer: str) -> Encoder:
    """The worker's encoder, kept from task to task until it does something else."""
    return held((lexicon, tokenizer), lambda: Encoder(Vocabulary(SparkFiles.get(tokenizer)), Lexicon.mapped(SparkFiles.get(lexicon))))


def _published(docs: DataFrame, text_col: str, path: str, words: int) -> tuple[str, str]:
    """Names of the lexicon's and the tokenizer's files; the lexicon is compiled from at most `words` pieces by one task."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        tokenizer = publish(spark, f.read(), "tokenizer")

    def compiled(table: pa.Table) -> pa.Table:
        let_go()
        vocabulary = Vocabulary(SparkFiles.get(tokenizer))
        found = dict.fromkeys(w.encode("utf-8", "surrogatepass") for p in sorted(table.column("piece").to_pylist()) for w in split_piece(" " + p))
        return pa.table({"block": pa.array([compile_lexicon({w: vocabulary.merge(w) for w in found})], pa.binary())})

    rows = frequent_pieces(docs, text_col, words)
    blocks = rows.groupBy(F.lit(0).alias("all")).applyInArrow(compiled, "block binary").collect()
    return publish(spark, bytes(blocks[0].block) if blocks else compile_lexicon({}), "lexicon"), tokenizer


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """Return ``(doc_id, n_tokens, ids)`` for each document: the whole text's ids as `tokenizers` gives them.

    A null or empty text has no ids; a null id stays null; repeated rows stay; texts of any length are encoded whole and
    a word of any length in n log n. Other columns are left out. An empty table gives no rows.
    """
    path = path or default_path()
    files = _published(docs, text_col, path, words)

    def make():
        enc = _encoder(*files)

        def run(texts: list[str]) -> dict:
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in enc.encode_many(texts)]
            return {"n_tokens": [len(i) for i in ids], "ids": ids}

        return run

    return map_texts(docs, make, "n_tokens long, ids array<int>", GROUP_BYTES, id_col, text_col, files)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`encoded` with ``text``: the ids turned back; bytes that aren't UTF-8 become the replacement character. Null ids give null."""
    with open(path or default_path(), "rb") as f:
        tokenizer = publish(encoded.sparkSession, f.read(), "tokenizer")

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Vocabulary(SparkFiles.get(tokenizer)).words
        for s in batches:
            yield s.map(lambda ids: None if ids is None else b"".join([words[i] for i in ids]).decode("utf-8", "replace"))

    return encoded.withColumn("text", text(ids_col))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: what `encode` and `decode` give, as digests, in one pass."""
    path = path or default_path()
    files = _published(docs, text_col, path, LEXICON_WORDS)

    def make():
        enc = _encoder(*files)

        def run(texts: list[str]) -> dict:
            ids = enc.encode_many(texts)
            decoded = [hashlib.sha256(enc.decode(i).encode()).hexdigest() for i in ids]
            return {"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids], "decoded_sha256": decoded}

        return run

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", GROUP_BYTES, id_col, text_col, files)


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
