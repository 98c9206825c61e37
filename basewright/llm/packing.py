"""Best-fit packing with certified repacking.

1. Whole texts become token ids (end id appended) and are cut into pieces of CAPACITY only where longer.
2. Pieces are dealt by hash into partitions. Each packs its pieces by best-fit decreasing and compares its bin count with a
   lower bound from dual-feasible functions; where both agree the partition is certified: no packing of it has fewer bins.
3. Bins that are full to within SLACK are final. The others are opened: a partition with a gap hands over all of them, a
   certified one its least filled bin (that is where a bin can still be saved across partitions). Their pieces are dealt anew
   to partitions of about LAST pieces, fewer from round to round as bins close, and packed again. Rounds end with one partition,
   after ROUNDS, or when the bin count meets the bound of the whole input.

Only (id, piece, length) rows are packed; a partition holds about PER_PARTITION of them.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, freed, shuffle_partitions, table

CAPACITY, END = 4096, 1
PER_PARTITION, LAST, SLACK, ROUNDS = 200_000, 50_000, 8, 6
CACHE, LONG, SLICE = 200_000, 100, 1 << 20
#: What Encoder.encode_all takes apart by itself; a tokenizer that normalizes or splits otherwise encodes each text whole.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
WHITE, LETTER, OTHER, NUMBER, STRANGE = range(5)  # kinds of characters; from NUMBER on each is a part by itself


class _Recent:
    """The values of about the last CACHE to 2 * CACHE keys used; keys over LONG are not kept."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def miss(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONG:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got

    def all(self, keys: list) -> list:
        return [self.new.get(k) or self.miss(k) for k in keys]


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer turns white space into breaks and never joins across them, so a text's ids are those of its chunks between
    spaces one after another. Chunks of Latin letters and signs, which normalization leaves alone but for the case, are split
    into the tokenizer's parts for many texts at once; each distinct part takes its ids from the merges, and recent ones are
    kept. Any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = spec["normalizer"]["normalizers"] == NORMAL and spec["pre_tokenizer"]["pretokenizers"][0] == SPLIT
        plain = [chr(c) for c in (*range(33, 127), *range(161, 0x250)) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250]
        self.kinds = np.zeros(0x250, np.uint8)
        self.kinds[0] = STRANGE
        for c in plain:
            self.kinds[ord(c)] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)
        self.white = re.compile("[ \n\t\r]")
        self.strange = re.compile("[^ \n\t\r" + re.escape("".join(plain)) + "]")
        # a byte stands for itself where Latin-1 prints it, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.byte = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}
        self.parts, self.chunks = _Recent(self._part), _Recent(self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: bytes) -> bytes:
        shown = part.decode() if part.isascii() else "".join(map(self.byte.__getitem__, part))
        return np.array([t.id for t in self.tokenize(shown)], "<u4").tobytes()

    def _starts(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokenizer's parts of UTF-8 text start, and which bytes aren't white space. The text ends with three line ends."""
        lead = np.flatnonzero(b >= 0xC2)  # all are characters of two bytes
        kind = self.kinds[b]
        kind[lead] = kind[lead + 1] = self.kinds[(b[lead] & 0x1F).astype(np.int64) << 6 | b[lead + 1] & 0x3F]
        solid = kind != WHITE
        start = solid & (kind >= NUMBER)
        start[0] = solid[0]
        start[1:] |= solid[1:] & (kind[1:] != kind[:-1])
        start[lead + 1] = False
        at = np.flatnonzero((b == ord("'")) & start)
        first, second = b[at + 1], b[at + 2]
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = (np.isin(first, np.frombuffer(b"rv", np.uint8)) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        start[at[one | two] + 1] = False
        for after in (at[one] + 2, at[two] + 3):
            start[after] = solid[after]
        return start, solid

    def _slice(self, texts: list[str], strange: list[str]) -> list[bytes]:
        """The ids of lower-cased texts, in which a NUL stands for each of the strange chunks."""
        data = [t.encode() + b"\n" for t in texts]
        b = np.frombuffer(b"".join([*data, b"\n\n"]), np.uint8)
        start, solid = self._starts(b)
        if not start.any():
            return [b""] * len(texts)
        heads = np.append(np.flatnonzero(start[solid]), np.count_nonzero(solid)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(heads) - 1, [None, pa.py_buffer(heads), pa.py_buffer(b[solid])]).dictionary_encode()
        distinct, codes = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        if strange:
            mark, codes = distinct.index(b"\0"), codes.copy()
            codes[codes == mark] = np.arange(len(distinct), len(distinct) + len(strange))
            distinct[mark] = b""
        ids = pa.array(self.parts.all(distinct) + self.chunks.all(strange), pa.binary()).take(pa.array(codes))
        ends = np.searchsorted(np.flatnonzero(start), np.cumsum([len(d) for d in data]))
        cuts = [0, *np.frombuffer(ids.buffers()[1], np.int32)[ends].tolist()]
        out = memoryview(ids.buffers()[2] or b"")
        return [bytes(out[i:j]) for i, j in zip(cuts, cuts[1:])]

    def _marked(self, text: str, strange: list[str]) -> str:
        """The lower-cased text with a NUL for each strange chunk, which goes to the list as it is."""
        out = []
        for chunk in self.white.split(text):
            if self.strange.search(chunk):
                strange.append(chunk)
                chunk = "\0"
            out.append(chunk)
        return " ".join(out).lower()

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, worked out for about SLICE characters at once; a longer text is parted at white space."""
        low, last, strange, begun = [], [], [], []

        def ready() -> Iterator[bytes]:
            for ids, end in zip(self._slice(low, strange), last, strict=True):
                begun.append(ids)
                if end:
                    yield b"".join(begun)
                    begun.clear()
            for held in (low, last, strange):
                held.clear()

        size = 0
        for text in texts:
            whole, at = not self.known or any(s in text for s in self.special), 0
            while at is not None:
                cut = None if whole or len(text) - at <= SLICE else self.white.search(text, at + SLICE)
                to = cut.start() if cut else len(text)
                if whole:
                    strange.append(text)
                    low.append("\0")
                else:
                    segment = text[at:to]
                    low.append(self._marked(segment, strange) if self.strange.search(segment) else segment.lower())
                last.append(cut is None)
                size, at = size + to - at, to if cut else None
                if size >= SLICE:
                    yield from ready()
                    size = 0
        yield from ready()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


_encoders: dict[str, Encoder] = {}
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode, tail = _encoders[path].encode_all, np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for d, ids in zip(batch.column(0), encode(t.as_py() or "" for t in batch.column(1)), strict=True):
                ids, d = ids + tail, d.as_py()
                for i, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((d, i, start // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)
    return run


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing of counts[length] pieces needs, by the best of several dual-feasible functions.

    The plain sum; f_e, which rounds lengths over capacity - e up to capacity and drops those under e; and u_k, which rounds
    (k + 1) * length / capacity down unless it is whole. Each is a fixed few dozen parameters.
    """
    if not counts:
        return 0
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(i)] for i in x], np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for e in sorted({capacity // 2, *(capacity * i // 48 for i in range(1, 24))}):
        f = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
        best = max(best, -(-int((f * n).sum()) // capacity))
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        f = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((f * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each piece; lengths must descend. Bins with equal room are interchangeable, so they wait in one stack."""
    rooms: list[int] = []
    stacks: dict[int, list[int]] = {}
    out, bins = [], 0
    for n in lengths:
        i = bisect.bisect_left(rooms, n)
        if i < len(rooms):
            room = rooms[i]
            b = stacks[room].pop()
            if not stacks[room]:
                del stacks[room], rooms[i]
        else:
            room, b, bins = capacity, bins, bins + 1
        room -= n
        out.append(b)
        if room:
            if room not in stacks:
                stacks[room] = []
                bisect.insort(rooms, room)
            stacks[room].append(b)
    return out


_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_()), ("bound", pa.int64())])


def _pack(capacity: int, last: bool):
    """Pieces of whole partitions, part by part and longest first -> their bins and places."""

    def finish(part: int, rows: list[tuple]) -> pa.RecordBatch:
        lengths = [r[1] for r in rows]
        bins = best_fit_decreasing(lengths, capacity)
        fill: dict[int, int] = {}
        at = []
        for b, n in zip(bins, lengths, strict=True):
            at.append(fill.get(b, 0))
            fill[b] = at[-1] + n
        counts: dict[int, int] = {}
        for n in lengths:
            counts[n] = counts.get(n, 0) + 1
        bound = lower_bound(counts, capacity)
        least = min(fill.values())
        done = [last or fill[b] >= capacity - SLACK or (len(fill) == bound and fill[b] > least) for b in bins]
        cols = [[r[2] for r in rows], [r[3] for r in rows], lengths, [r[4] for r in rows], [part] * len(rows), bins, at, done, [bound] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACKED, strict=True)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != now and rows:
                    yield finish(now, rows)
                    rows = []
                now = r[0]
                rows.append(r)
        if rows:
            yield finish(now, rows)
    return run


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row's pieces; a null or empty text is its end id alone."""
    return documents.select("doc_id", "text").mapInArrow(freed(_pieces(path, capacity, end)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, checkpointed) -> with sequence_id and offset, gapless from 0 in each sequence.

    Repeated rows are packed as often as they occur; ties are broken by nothing that changes the number of sequences; an
    empty table gives no rows. A piece is never dropped or cut again.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    n, bound = sum(r.n for r in counts), lower_bound({r.length: r.n for r in counts}, capacity)
    parts, done, closed = max(1, -(-n // PER_PARTITION)), None, 0
    todo = rows.select("doc_id", "piece", "length", "ids_crc32")
    for turn in range(ROUNDS):
        last = parts == 1 or turn == ROUNDS - 1
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(parts)).cast("int"))
        dealt = dealt.repartition(min(parts, shuffle_partitions(spark)), "part").sortWithinPartitions("part", F.desc("length"), "doc_id", "piece")
        out = dealt.select("part", "length", "doc_id", "piece", "ids_crc32").mapInArrow(freed(_pack(capacity, last)), "doc_id long, piece int, length long, ids_crc32 long, part int, bin long, offset long, done boolean, bound long")
        out = checkpointed(out.withColumn("turn", F.lit(turn)))
        ready = out.where("done")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        todo = out.where("NOT done").select("doc_id", "piece", "length", "ids_crc32")
        bins = out.groupBy("part").agg((F.max("bin") + 1).alias("b"), F.countDistinct(F.when(~F.col("done"), F.col("bin"))).alias("o"), F.sum(F.when(F.col("done"), 0).otherwise(1)).alias("n"))
        used, opened, left = (x or 0 for x in bins.agg(F.sum("b"), F.sum("o"), F.sum("n")).first())
        closed += used - opened
        if not left:
            break
        if closed + opened <= bound:  # certified as a whole: nothing left to gain
            done = done.unionByName(out.where("NOT done"))
            break
        parts = -(-left // LAST)
    span = F.col("turn").cast("long") * (1 << 56) + F.col("part").cast("long") * (1 << 32) + F.col("bin")
    return done.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32", span.alias("sequence_id"), "offset")


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenize, cut and pack whole documents. Extra columns are ignored; null doc_ids are kept."""
    return pack_pieces(checkpointed(pieces(documents, path, capacity, end)), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
