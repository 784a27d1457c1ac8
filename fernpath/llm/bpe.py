"""Byte-level BPE encoding and decoding: a mapped lexicon of frequent words, exact merges for all others."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernpath.llm.chunks import Encoder, lasting, load
from fernpath.llm.common import blocks, most_frequent, out, raw, release, stash, table
from fernpath.llm.lexicon import Lexicon, compiled

#: Words in the lexicon: the most frequent ones of the corpus. It bounds what is broadcast; no id depends on it.
LEXICON_WORDS = 50_000
#: A byte that UTF-8 never has.
END_MARK = b"\xff"
#: Chunks of characters whose class every table of Unicode has had alike for long: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari,
#: kana, Han, Hangul and common punctuation. Others are left to the library, so that no two tables can disagree.
SETTLED = regex.compile(
    "[\u0000-\u024f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0660-\u0669\u0905-\u0939"
    "\u0966-\u096f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u21ff\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff0f]*+"
).fullmatch

#: White space goes with the word behind it; at the end of a text it stands alone. No piece of a text crosses such a border.
CHUNK = re.compile(r"\s*\S+|\s+")


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]


class Merger:
    """Applies a vocabulary's merges to words: always the pair of lowest rank, leftmost first. Ids are in order of the merges.

    Where the vocabulary marks the ends of words, a byte that no text has stands for the mark.
    """

    def __init__(self, path: str):
        with open(path) as file:
            model = json.load(file)["model"]
        back, end = {c: b for b, c in enumerate(byte_names())}, model.get("end_of_word_suffix") or ""
        ranks = {}
        for token, i in model["vocab"].items():
            last = bool(end) and token.endswith(end)
            body = token[: len(token) - len(end)] if last else token
            if all(c in back for c in body):
                ranks[bytes(back[c] for c in body) + END_MARK * last] = i
        self.end = END_MARK if end else b""
        self.core = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def piece(self, data: bytes) -> list[int]:
        return self.core.encode_single_piece(data + self.end)


def _split(text: str) -> list[str]:
    return CHUNK.findall(text)


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes that each id stands for; ids of added tokens stand for the tokens' own text."""
    with open(path) as file:
        spec = json.load(file)
    back = {c: b for b, c in enumerate(byte_names())}
    found = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
    return found | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class Codec:
    """Ids of texts and texts of ids, as the vocabulary's own library gives them."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        self.tokenizer, self.merger, known = load(path), Merger(path), token_bytes(path)
        self.bytes = np.array([known.get(k, b"") for k in range(max(known) + 1)], object)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.encoder = Encoder(self.tokenizer, _split, self._chunks)

    def _chunk(self, chunk: str) -> list[int]:
        data = chunk.encode()
        if self.lexicon and (found := self.lexicon.get(data)) is not None:
            return found
        if not SETTLED(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return [i for piece in self.merger.pattern.findall(chunk) for i in self.merger.piece(piece.encode())]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._chunk(c) for c in chunks]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.block(texts)

    def decode(self, ids) -> str:
        return b"".join(self.bytes[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent chunks of all texts, `most` at most; chunks found once are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        found: Counter = Counter()
        for part in blocks(batches):
            for text in part.column("text").to_pylist():
                found.update(CHUNK.findall(text.decode()))
            if len(found) > 200_000:
                yield out(schema, list(found), list(found.values()))
                found.clear()
        yield out(schema, list(found), list(found.values()))

    counts = raw(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stash(counts, "words")
    found = [r.word for r in most_frequent(counts, most)[0].select("word").collect()]
    release(counts)
    return found


def build_lexicon(words: list[str], path: str) -> bytes:
    tokenizer = load(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    words = [w for w in words if not any(s in w for s in special)]
    return compiled({w.encode(): e.ids for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)})


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for each row of documents; a null text counts as empty.

    A special token's string in a text is that token, as in the library. `path` names a byte-level vocabulary file. Rows are
    encoded one by one, so that repeated rows and ids have equal results.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build_lexicon(frequent_words(docs), path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = lasting("bytes", (path, xxhash.xxh3_64_digest(shared.value)), lambda: Codec(path, shared.value))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part in blocks(batches, keep=True):
            found = codec.encode([t.decode() for t in part.column("text").to_pylist()])
            yield out(schema, part.column("doc_id"), [len(x) for x in found], [sha(x.astype("<u4").tobytes()) for x in found], [sha(codec.decode(x).encode()) for x in found])

    return raw(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, by digests; see `round_trip` for odd rows."""
    return round_trip(table(spark, sf_dir, "documents"))
