"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words (the tokenizer's own pre-tokens) by vector operations
over their characters. Consecutive texts of a task make a block of about
BLOCK_BYTES (a longer text is a block of its own); a block is written as the
places of its words, numbers into the block's list of distinct words, and that
list, dealt into buckets by the words' hashes. A word is in one bucket wherever
it stands, and there it is encoded once. Its ids go back to the blocks that have
it, and a block's texts take them by position.

Decoding is a join on id: the distinct ids of a few MB of ids meet the table of
pieces, which has one row for each id of the vocabulary and is broadcast within
BROADCAST_BYTES; the pieces take the ids' positions and the bytes are read as
UTF-8 (a broken sequence becomes U+FFFD).

No task holds more than a block and the distinct words of a bucket. A word that
all documents share is one entry of each block, so no key is hot.

Added tokens of the tokenizer (here <|endoftext|>) that stand in a text are
themselves one id, as in the tokenizers library. A null or empty text has no ids
and decodes to the empty text. A null doc_id is kept. Repeated rows give equal
rows, long texts are encoded whole, empty tables give empty results, other
columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import kernels as K
from .shared import BROADCAST_BYTES, load, materialise_by, shrink

#: Text bytes of a block.
BLOCK_BYTES = 16 << 20
#: Text bytes that a bucket of distinct words stands for, and the most buckets.
BUCKET_BYTES = 4 << 20
BUCKETS = 1 << 16
#: Words encoded in one call, and ids decoded at once.
CALL_WORDS = 1 << 12
DECODE_BYTES = 1 << 20
#: Numbers, or words of texts, handled at once.
PART = 1 << 17
#: Bytes of text split, or of ids read as text, at once: either takes tens of bytes of memory for each byte.
SLICE_BYTES = 1 << 18
# White space of the tokenizer's pattern besides the blank.
_SPACES = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Kinds of characters.
_OTHER, _LETTER, _NUMBER, _SPACE, _BLANK = range(5)
# Endings that an apostrophe begins, by their letters.
_ENDINGS = ["s", "t", "m", "d", "re", "ve", "ll"]
_kinds: list[np.ndarray] = []
_tokenizers: dict[str, object] = {}


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's content; it is read by the driver alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _special(spec: str) -> dict[str, int]:
    j = json.loads(spec)
    if j["pre_tokenizer"] != j["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or j["normalizer"]:
        raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"]):
        raise ValueError("added tokens that take their surroundings are not supported")
    return {t["content"]: t["id"] for t in j["added_tokens"]}


def kinds() -> np.ndarray:
    """The kind of each code point; made once for each process."""
    if not _kinds:
        import regex

        out = np.zeros(0x110000, np.uint8)
        for at in range(0, len(out), 1 << 14):
            text = "".join(map(chr, [c for c in range(at, at + (1 << 14)) if not 0xD800 <= c < 0xE000]))
            for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
                out[[ord(c) for c in regex.findall(pattern, text)]] = kind
        out[_SPACES], out[0x20] = _SPACE, _BLANK
        _kinds.append(out)
    return _kinds[0]


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the words of texts that lie one after another in data. Words have no gaps; none spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(c)
    at = np.arange(n + 1)
    if n < len(data):
        at[1:] = np.cumsum(1 + (c >= 0x80) + (c >= 0x800).astype(np.int64) + (c >= 0x10000))
    kind = kinds()[c]
    blank = kind == _BLANK
    kind[blank] = _SPACE
    edge = np.zeros(n + 1, bool)  # a text's first character, or the end of all
    edge[np.searchsorted(at, offsets)] = True
    edge[n] = True
    first = edge.copy()
    first[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(first)
    start, end = runs[:-1], runs[1:]
    # Of white space before a word its last character stands apart; a blank there is the word's own.
    ends = end[(kind[start] == _SPACE) & ~edge[end]]
    first[ends - 1] = True
    first[ends[blank[ends - 1]]] = False
    # An apostrophe that begins a word takes a known ending from the letters behind it.
    quote = np.flatnonzero((c == 0x27) & first[:n])
    quote = quote[~edge[quote + 1]]
    one = np.append(c, [0, 0])
    for letters in _ENDINGS:
        hit = quote
        for k, letter in enumerate(letters, 1):
            hit = hit[one[hit + k] == ord(letter)]
            hit = hit[~edge[hit + k]]
        first[hit + 1] = False
        first[hit + len(letters) + 1] = True
    return at[np.flatnonzero(first[:n])]


def find(data: np.ndarray, offsets: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of words and added tokens, and the first word of each text (n + 1 values)."""
    raw, spans = None, []
    if special:
        raw = data.tobytes()
        if any(s.encode() in raw for s in special):
            import regex

            pattern = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(special, key=len, reverse=True)))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                spans += [m.span() for m in pattern.finditer(raw, a, b)]
    if not spans:
        starts = split(data, offsets)
    else:
        span = np.array(spans, np.int64)
        starts = split(data, np.unique(np.concatenate((offsets, span.ravel()))))
        k = np.maximum(np.searchsorted(span[:, 0], starts, "right") - 1, 0)
        starts = starts[~((starts > span[k, 0]) & (starts < span[k, 1]))]
    return starts, np.searchsorted(starts, offsets)


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2**28, seven bits a byte, compressed."""
    parts = []
    for at in range(0, len(x), PART):
        part = x[at : at + PART].astype(np.uint32)
        n = (1 + (part >= 1 << 7) + (part >= 1 << 14) + (part >= 1 << 21)).astype(np.int32)
        ends = np.cumsum(n)
        out = np.zeros(int(ends[-1]), np.uint8)
        for i in range(4):
            has = n > i
            out[ends[has] - n[has] + i] = ((part[has] >> np.uint32(7 * i)) & np.uint32(127)) | np.where(n[has] > i + 1, 128, 0).astype(np.uint32)
        parts.append(out)
    return _pressed(b"".join(p.tobytes() for p in parts))


def _unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(_unpressed(raw), np.uint8)
    out = np.zeros(np.count_nonzero(b < 128), np.int32)
    at = done = 0
    while at < len(b):
        stop = min(at + PART, len(b))
        while b[stop - 1] >= 128:
            stop += 1
        ends = np.flatnonzero(b[at:stop] < 128) + at + 1
        starts = np.concatenate(([at], ends[:-1]))
        part = out[done : done + len(ends)]
        for i in range(4):
            has = ends - starts > i
            part[has] |= (b[starts[has] + i].astype(np.int32) & 127) << np.int32(7 * i)
        at, done = stop, done + len(ends)
    return out


def _pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _unpressed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True) if raw else b""


_BLOCK = "block long, bucket int, ids array<long>, n array<long>, places binary, buckets binary, words binary"


def _blocks(special: dict[str, int], buckets: int, block_bytes: int):
    """Of each block, a row without bucket (its texts), and a row for each bucket (words, by falling count)."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    kinds_ = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds_)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # The same word of several slices becomes one.
            hashes, at, own = distinct(np.concatenate([h[2] for h in held]))
            places, a, w = np.empty(sum(len(h[3]) for h in held), np.int32), 0, 0
            count = np.zeros(len(hashes), np.int64)
            for h in held:
                part = places[a : a + len(h[3])]
                np.take(own[w : w + len(h[2])], h[3], out=part)
                count += np.bincount(part, minlength=len(hashes))
                a, w = a + len(part), w + len(h[2])
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            bucket = (K.mix(hashes, 5) % K.U(buckets)).astype(np.int32)[order]
            ids, n = [i for h in held for i in h[0]], np.concatenate([h[1] for h in held])
            length, text = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
            held.clear()
            del h, part
            for a in range(0, len(places), PART):
                places[a : a + PART] = rank[places[a : a + PART]]
            yield row(block, None, ids, n, _packed(places), _packed(bucket), None)
            del places, ids, n
            start, at = np.cumsum(length) - length, at[order]
            by = np.argsort(bucket, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                words = _cut(text, start[at[group]], length[at[group]])
                body = length[at[group]].astype("<u4").tobytes() + words.tobytes()
                yield row(block, int(bucket[group[0]]), None, None, None, None, len(group).to_bytes(4, "little") + _pressed(body))

        for batch in K.slices(batches, limit=min(SLICE_BYTES, block_bytes)):
            data, offsets = K.texts(batch.column("text"))
            starts, first = find(data, offsets, special)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            hashes, at, places = distinct(K.hashes(data, starts, ends))
            if held and size + len(data) > block_bytes:
                yield from flush()
                K.release()
                size, block = 0, block + 1
            length = (ends - starts)[at]
            held.append((batch.column("doc_id").to_pylist(), np.diff(first), hashes, places, length, _cut(data, starts[at], length)))
            size += len(data)
        if held:
            yield from flush()

    return run


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order of appearance, where each stands first, and each value's number among them."""
    d = pa.array(x).dictionary_encode()
    number = d.indices.to_numpy()
    first = np.ones(len(x), bool)
    first[1:] = number[1:] > np.maximum.accumulate(number)[:-1]
    return d.dictionary.to_numpy(), np.flatnonzero(first), number


def _cut(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given stretches of data, one after another."""
    stop = np.cumsum(lengths)
    return data[np.repeat(starts - stop + lengths, lengths) + np.arange(stop[-1] if len(stop) else 0)]


def _words(raw: bytes) -> list[bytes]:
    n, body = int.from_bytes(raw[:4], "little"), _unpressed(raw[4:])
    ends = (np.cumsum(np.frombuffer(body, "<u4", n), dtype=np.int64) + 4 * n).tolist()
    return [body[a:b] for a, b in zip([4 * n, *ends[:-1]], ends)]


def tokenizer(spec: str):
    """The library's tokenizer; read once for each process."""
    if spec not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs in parallel
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(spec)
        own.no_truncation()
        own.no_padding()
        _tokenizers.clear()
        _tokenizers[spec] = own
        K.release()  # what reading the file took
    return _tokenizers[spec]


def forget() -> None:
    """For workers that encode no words: they may have done so in a task before, and hold the tokenizer and what it remembers."""
    if _tokenizers:
        _tokenizers.clear()
        K.release()


class Encoder:
    """Words and their ids, each encoded once."""

    def __init__(self, spec: str):
        self.tokenizer = tokenizer(spec)
        self.index: dict[bytes, int] = {}
        self.ids: list[bytes] = []

    def __call__(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in words if w not in self.index]
        for i in range(0, len(new), CALL_WORDS):
            part = new[i : i + CALL_WORDS]
            for w, e in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)):
                self.index[w] = len(self.ids)
                self.ids.append(np.array(e.ids, "<u4").tobytes())
        return [self.ids[self.index[w]] for w in words]


def _encode_bucket(spec):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(spec.value)
        for batch in batches:
            out = []
            for raw in batch.column("words").to_pylist():
                ids = encode(_words(raw))
                out.append(_joined(ids))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "encoded"])

    return run


def _joined(ids: list[bytes]) -> bytes:
    lengths, flat = _packed(np.array([len(i) // 4 for i in ids])), _packed(np.frombuffer(b"".join(ids), "<u4"))
    return len(lengths).to_bytes(4, "little") + lengths + flat


def _parted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(raw[:4], "little")
    return _unpacked(raw[4:cut]), _unpacked(raw[cut:])


_ENCODED = ["doc_id", "n_tokens", "ids"]


def _by_position(asking: bool):
    """A block's texts as ids; asking: with the rows that ask for the pieces of ids."""

    def run(texts: pa.Table, encoded: pa.Table) -> pa.Table:
        forget()
        out = _positioned(texts, encoded)
        return pa.Table.from_batches(_distinct_ids(_ENCODED)(iter(out.to_batches())), out.schema.append(pa.field("_id", pa.int32())).append(pa.field("_rest", pa.int32()))) if asking else out

    return run


def _positioned(texts: pa.Table, encoded: pa.Table) -> pa.Table:
    out = []
    encoded = encoded.sort_by("bucket")
    parts = [_parted(r) for r in encoded.column("encoded").to_pylist()]
    lengths = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    flat = np.concatenate([p[1] for p in parts]).astype("<u4") if parts else np.zeros(0, "<u4")
    starts = np.cumsum(lengths) - lengths
    for row in texts.to_pylist():
        # Words came by bucket, and by rank in each; back to the order of ranks.
        by = np.argsort(_unpacked(row["buckets"]), kind="stable")
        length, start = np.empty_like(lengths), np.empty_like(starts)
        length[by], start[by] = lengths, starts
        places, counts = _unpacked(row["places"]), np.array(row["n"], np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        n_tokens, ids, a = [], [], 0
        while a < len(counts):
            b = max(a + 1, int(np.searchsorted(first, first[a] + PART, "right")) - 1)
            p = places[first[a] : first[b]]
            n = length[p]
            stop = np.concatenate(([0], np.cumsum(n)))
            raw = _cut(flat, start[p], n).tobytes()
            cut = stop[first[a : b + 1] - first[a]]
            n_tokens += np.diff(cut).tolist()
            ids += [raw[4 * x : 4 * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            a = b
        out.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.binary())], _ENCODED))
    return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], _ENCODED)


def encode(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    return _encode(docs, path, id, text, block_bytes, buckets, False)


def encode_and_decode(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """As decode(encode(docs)), with a Python worker less in each task."""
    return _with_pieces(_encode(docs, path, id, text, block_bytes, buckets, True), path)


def _encode(docs: DataFrame, path: str | None, id: str, text: str, block_bytes: int, buckets: int | None, asking: bool) -> DataFrame:
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spec = tokenizer_json(path)
    if buckets is None:
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = int(min(BUCKETS, max(1, -(-total // BUCKET_BYTES))))
    # Dealt by block as they are written, places need no shuffle to meet their ids.
    blocks = materialise_by(docs.mapInArrow(_blocks(_special(spec), buckets, block_bytes), _BLOCK), "blocks", "block")
    shrink(docs.sparkSession)
    words = word_table(blocks, spec)
    texts = blocks.where("bucket is null").select("block", "ids", "n", "places", "buckets")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_by_position(asking), "doc_id long, n_tokens long, ids binary" + ", _id int, _rest int" * asking)


def word_table(blocks: DataFrame, spec: str) -> DataFrame:
    """(block, bucket, encoded): the ids of each block's words of a bucket. A bucket's distinct words are encoded once."""
    words = blocks.where("bucket is not null").select("block", "bucket", "words")
    given = blocks.sparkSession.sparkContext.broadcast(spec)
    return words.groupBy("bucket").applyInArrow(_encode_bucket(given), "block long, bucket int, encoded binary")


def pieces(spec: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of the whole vocabulary."""
    # Fixed values of byte-level BPE: printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    j = json.loads(spec)
    vocabulary = j["model"]["vocab"] | {t["content"]: t["id"] for t in j["added_tokens"]}
    return [(i, bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()) for piece, i in vocabulary.items()]


def _distinct_ids(names: list[str]):
    """The rows, in runs of a few MB of ids; behind each run a row for each distinct id in it. _rest: how many such rows follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "ids", DECODE_BYTES):
            ids = np.unique(K.texts(batch.column("ids"))[0].view("<u4"))
            n, rest = batch.num_rows, [pa.nulls(len(ids), c.type) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.int32()), pa.array([len(ids)] * n, pa.int32())], [*names, "_id", "_rest"])
            if len(ids):
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids.astype(np.int32)), pa.array(np.arange(len(ids))[::-1], pa.int32())], [*names, "_id", "_rest"])

    return run


def _decode(names: list[str]):
    def decoded(batch: pa.RecordBatch, ids: np.ndarray, found: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in found], np.int64)
        flat, starts = np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths
        data, ends = K.texts(batch.column("ids"))
        own = np.searchsorted(ids, data.view("<u4"))
        n = lengths[own]
        stop = np.concatenate(([0], np.cumsum(n)))
        raw = _cut(flat, starts[own], n).tobytes()
        cut = stop[ends // 4].tolist()
        text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*names, "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows, ids, found, due = [], [], [], 0
        for batch in batches:
            is_row = pc.is_null(batch.column("_id")).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(is_row[1:] != is_row[:-1]) + 1).tolist(), len(is_row)]
            for a, b in zip(cut[:-1], cut[1:]):
                part, rest = batch.slice(a, b - a), batch.column("_rest").slice(a, b - a).to_numpy()
                if is_row[a]:
                    none = part.filter(pa.array(rest == 0)).select(names)
                    if none.num_rows:
                        yield decoded(none, np.zeros(0, np.int64), [])
                    rows.append(part.filter(pa.array(rest > 0)).select(names))
                    due = max(due, int(rest.max()))
                    continue
                ids.append(part.column("_id").to_numpy().astype(np.int64))
                found += [b"" if p is None else p for p in part.column("piece").to_pylist()]
                if rest[-1] == 0:
                    known = np.concatenate(ids)
                    if len(known) != due or (np.diff(known) <= 0).any():
                        raise RuntimeError("the join with the pieces has changed the order of its rows")
                    for r in rows:
                        for some in K.cut(r, "ids", SLICE_BYTES):
                            yield decoded(some, known, found)
                    rows, ids, found, due = [], [], [], 0
        if due:
            raise RuntimeError("the join with the pieces has lost rows")
        K.release()

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with a column decoded, the text of its ids. An id without a piece stands for no bytes, as in the library."""
    names, schema = encoded.columns, encoded.schema
    return _with_pieces(encoded.mapInArrow(_distinct_ids(names), T.StructType([*schema.fields, T.StructField("_id", T.IntegerType()), T.StructField("_rest", T.IntegerType())])), path)


def _with_pieces(asked: DataFrame, path: str | None) -> DataFrame:
    """asked: rows, and rows that ask for the pieces of their ids."""
    spark, vocabulary = asked.sparkSession, pieces(tokenizer_json(path))
    if sum(len(p) + 64 for _, p in vocabulary) > BROADCAST_BYTES:
        raise ValueError("the vocabulary is larger than a broadcast may be")
    table = spark.createDataFrame(vocabulary, "_piece_id int, piece binary")
    # A broadcast join keeps the order of the streamed rows; _decode raises if it doesn't.
    met = asked.join(F.broadcast(table), F.col("_id") == F.col("_piece_id"), "left").drop("_piece_id")
    rows = asked.schema.fields[:-2]
    return met.mapInArrow(_decode([f.name for f in rows]), T.StructType([*rows, T.StructField("decoded", T.StringType())]))


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    shrink(spark)
    return digest(encode_and_decode(docs))
