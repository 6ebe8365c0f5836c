"""Vector best-fit packing of tokenised documents into fixed-length sequences.

A document's tokens are its ids followed by one separator. A document longer than a sequence is cut
into full-length pieces, of which the first may be shorter; nothing else is cut. Every piece has a
demand vector (tokens, documents, attention cost = tokens squared) and every open sequence a residual
vector. Pieces are placed longest first into the open sequence that can hold them under all three
capacities and scores best: the smallest weighted norm of what would be left, or the largest weighted
dot product of demand and residual. A new sequence opens only when none fits.

Scale: texts are read once and never shuffled. Only (document, piece, length) rows are dealt, by a
hash of their place, into shards of about ``shard_items`` pieces, each packed on its own; a shard
leaves at most a few sequences open, so the loss against one global packing is a constant per shard.

Order: with a ``position`` column, shards are contiguous ranges of it instead, and within a shard
sequences are numbered by the position of the piece that opened them, so sequence_id runs through the
documents in their order, up to the mixing of one shard. Positions are taken to be about evenly spread.

Defined results: null and empty texts are one separator token; a null doc_id is kept; repeated rows
are packed one by one; ties go by doc_id, then piece; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store

SEPARATOR = b"\0\0\0\0"
#: Texts' first chunks, later ones, and runs in a generation of a worker's memos.
FIRST_LIMIT, CHUNKS_LIMIT, RUNS_LIMIT = 10_000, 400_000, 300_000
#: Bytes of texts encoded together, and of a batch that a worker gets.
LOT_BYTES, BATCH_BYTES = 1 << 20, 2 << 20
#: A space that doesn't touch other white space, in its widest sense.
_LONE_SPACE = re.compile(r"(?<!\s) (?!\s)")
#: Characters whose class in the splitting pattern is sure: ASCII but the apostrophe, which begins contractions, and the
#: bar of special tokens, and the letters of Latin-1 from 192 on. A chunk's lines end one by one in its middle.
_RUNS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{}~]+|\n(?!\s)")
PLAIN = frozenset(c for c in map(chr, range(256)) if _RUNS.fullmatch(c)) | {" "}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class _Memo(dict):
    """Text -> its ids as little-endian unsigned 32-bit bytes; encode is asked for those not kept.

    Of two generations the older one goes when the newer is full, so texts that come again stay while
    those that come once pass through.
    """

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= 40:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class _OddSpaceError(Exception):
    """A text's spaces are not all lone ones."""


class TokenEncoder:
    """Ids of whole texts under a public byte-level BPE vocabulary, as its tokenizer gives them.

    The vocabulary's splitting pattern lets white space only begin a piece, and its special tokens hold
    none, so a single space between two other characters always starts a piece. Texts are cut there, and
    a worker encodes a chunk once while it is kept; a chunk that is empty or ends in white space shows that
    some of its text's spaces were not single. A chunk of ``PLAIN`` characters alone is cut on, as the pattern
    does, into runs of letters, digits and punctuation, and the tokenizer's model gets each run once in the form
    that its pre-tokenizer gives it; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        pre = tokenizer.pre_tokenizer
        self.cuts = (
            tokenizer.normalizer is None
            and isinstance(pre, ByteLevel)
            and pre.use_regex
            and not pre.add_prefix_space
            and not any(PLAIN.issuperset(t.content) for t in tokenizer.get_added_tokens_decoder().values())
        )
        self.forms = {ord(c): pre.pre_tokenize_str(c)[0][0] for c in PLAIN} if self.cuts else {}
        self.runs = _Memo(self._run, RUNS_LIMIT)
        self.first, self.rest = _Memo(self._first_chunk, FIRST_LIMIT), _Memo(self._later_chunk, CHUNKS_LIMIT)

    def _run(self, run: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(run.translate(self.forms))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        runs = _RUNS.findall(chunk) if self.cuts else ()
        if "".join(runs) != chunk:
            return array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.runs.__getitem__, runs))

    def _first_chunk(self, chunk: str) -> bytes:
        if chunk != chunk.rstrip():
            raise _OddSpaceError
        return self._chunk(chunk)

    def _later_chunk(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _OddSpaceError
        return self._chunk(" " + chunk)

    def _ids(self, text: str) -> bytes:
        head, *tail = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except _OddSpaceError:
            head, *tail = _LONE_SPACE.split(text)
            return self._chunk(head) + b"".join([self.rest[c] if c and c == c.strip() else self._chunk(" " + c) for c in tail])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self._ids(t) for t in texts]


_encoders: dict[str, TokenEncoder] = {}


def token_encoder(vocabulary: str) -> TokenEncoder:
    """The worker's encoder for a vocabulary of the public tokenizer files, made once."""
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders[vocabulary] = TokenEncoder(public_tokenizers.path(f"{vocabulary}.json"))
    return _encoders[vocabulary]


def piece_starts(n: int, size: int) -> list[int]:
    """Where the pieces of a document of n tokens begin; only the first may be shorter than size."""
    first = n % size or min(n, size)
    return [0, *range(first, n, size)]


def _encoded(encode: TokenEncoder, column: pa.Array):
    """Ids of a column's texts, nulls as empty ones, in lots of about a million bytes or one longer text."""
    sizes = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy().astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + LOT_BYTES, "right")))
        yield from encode([t or "" for t in column.slice(a, b - a).to_pylist()])
        a = b


def _tokenise(vocabulary: str, size: int):
    def run(batches):
        encode = token_encoder(vocabulary)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            repeats = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), _encoded(encode, batch.column(1)), strict=True):
                blob = ids + SEPARATOR
                n = len(blob) // 4
                starts = piece_starts(n, size)
                repeats.append(len(starts))
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    for column, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(memoryview(blob)[4 * a : 4 * b])), strict=True):
                        column.append(value)
            columns = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])]
            places = [batch.column(k).take(pa.array(np.repeat(np.arange(len(repeats)), repeats))) for k in range(2, batch.num_columns)]
            yield pa.record_batch([*columns, *places], names=["doc_id", "piece", "start", "length", "ids_crc32", *batch.schema.names[2:]])

    return run


def best_fit(lengths: np.ndarray, size: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for pieces given in the order of placement."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, n))
    number = np.zeros(n, np.int64)
    capacity = np.array([size, max_docs, max_cost], float)
    w = np.array(weights, float)
    opened = live = 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        best = -1
        if live:
            rest = left[:, :live] - need[:, None]
            fits = (rest >= 0).all(axis=0)
            if fits.any():
                if rule == "norm":
                    score = -(w[:, None] * (rest / capacity[:, None]) ** 2).sum(axis=0)
                else:
                    score = ((w * need / capacity)[:, None] * (left[:, :live] / capacity[:, None])).sum(axis=0)
                best = int(np.where(fits, score, -np.inf).argmax())
        if best < 0:
            if length > size or need[2] > max_cost or max_docs < 1:
                raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
            best, live = live, live + 1
            left[:, best], number[best], opened = capacity, opened, opened + 1
        bins[i], offsets[i] = number[best], size - left[0, best]
        left[:, best] -= need
        if left[0, best] < 1 or left[1, best] < 1 or left[2, best] < 1:
            live -= 1
            left[:, best], number[best] = left[:, live], number[live]
    return bins, offsets


def _pack_shard(size: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), size, max_docs, max_cost, weights, rule)
        shard = table["shard"][0].as_py()
        if "position" in table.column_names:
            _, opener = np.unique(bins, return_index=True)
            place = np.empty(len(opener), np.int64)
            place[np.lexsort((table["piece"].to_numpy()[opener], table["position"].to_numpy()[opener]))] = np.arange(len(opener))
            bins = place[bins]
        out = table.drop_columns([c for c in ("shard", "position") if c in table.column_names])
        return out.append_column("sequence_id", pa.array(bins + (shard << 32))).append_column("offset", pa.array(offsets))

    return run


def best_fit_pack(
    documents: DataFrame,
    *,
    vocabulary: str = "byte_bpe_50k",
    size: int = 2048,
    max_docs: int = 2048,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "norm",
    shard_items: int = 4096,
    position: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    position: a column of whole numbers in whose order sequences are made; without it any order will do.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(position).cast("long").alias("position")] if position else []))
    pieces = store.save(texts.mapInArrow(_tokenise(vocabulary, size), PIECES + (", position long" if position else "")), "pieces", BATCH_BYTES)
    if position:
        n, low, high = pieces.agg(F.count(F.lit(1)), F.min("position"), F.max("position")).first()
        shards = max(1, -(-n // shard_items))
        place = F.floor((F.col("position") - (low or 0)) * F.lit(shards / ((high or 0) - (low or 0) + 1)))
    else:
        shards = max(1, -(-pieces.count() // shard_items))
        place = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards))
    dealt = pieces.withColumn("shard", place.cast("long"))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(size, max_docs, float(max_cost or size * size), weights, rule), PACKED)
