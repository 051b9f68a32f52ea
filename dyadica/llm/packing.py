"""Packing documents into sequences by bounded-space online best fit.

A task reads its documents in order and keeps at most ``windows`` open sequences. A document's tokens (its
ids and one end id) are cut into full sequences and a rest. The rest goes into the open window it leaves
least room in. When it fits none and no further window may be opened, the head of the rest fills the fullest
window to the brim, which is emitted without padding, and the tail is placed anew. What a task still holds
open at its end is carried with its ids into merge rounds: the leftovers of ``fan_in`` tasks are packed in
the same way by one, until one task's windows are left. So at most ``windows`` sequences have padding, and
no task ever holds more than ``fan_in * windows`` sequences.

Token ids are those of the given tokenizer file. If it is a plain byte-level BPE whose ids follow the order of its
merges, tiktoken computes them from the same file, 2.6 times faster than the file's own library. That library
encodes texts with a special token's string or a very long run of white space, and all texts of any other file.

Defined results: a null or empty text is its end id alone; rows may repeat, each is packed; very long texts
fill many sequences; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, table

LENGTH, WINDOWS, FAN_IN, END = 2048, 64, 16, 1
_BLANK = 100_000  # characters of white space in a row, of which the faster library can run out of stack
# Fixed values of the byte-level scheme: the pattern of its words, and the letters that spell bytes (bytes
# without a visible character of their own get the letters from 256 on).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_BYTE = {chr(_SPELLED.get(b, b)): b for b in range(256)}
_PIECE = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, task long, ids binary")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(file: dict, special: list[str]) -> dict[bytes, int] | None:
    """Ids by the bytes of every token, if the file is a plain byte-level BPE with ids in the order of merges."""
    model, words = file["model"], file["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and not file["normalizer"] and words.get("type") == "ByteLevel" and words.get("use_regex", True)
             and not words.get("add_prefix_space") and not any(model.get(k) for k in (
                 "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    tokens = {t: i for t, i in model["vocab"].items() if t not in special}
    if merged != sorted(merged) or len(merged) + 256 != len(tokens) or not all(c in _BYTE for t in tokens for c in t):
        return None
    return {bytes(_BYTE[c] for c in t): i for t, i in tokens.items()}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = byte_ranks(json.load(f), self.special)
        self.fast = None
        if ranks:
            import tiktoken
            self.fast = tiktoken.Encoding(path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or (
                len(text) >= _BLANK and re.search(r"\s{%d}" % _BLANK, text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self._ids(t)).tobytes() for t in texts]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


class Packer:
    """Open windows of one task; ``place`` yields the pieces of every window it emits."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.limit, self.next_id = length, windows, first_id
        self.open: list[list] = []  # [fill, pieces]

    def _emit(self, pieces: list[tuple]) -> list[tuple]:
        sequence, self.next_id = self.next_id, self.next_id + 1
        out, offset = [], 0
        for doc_id, start, ids, tokens in pieces:
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, ids))
            offset += len(ids) // 4
        return out

    def place(self, doc_id, start: int, ids: bytes, tokens: int) -> Iterator[list[tuple]]:
        while len(ids) >= 4 * self.length:
            yield self._emit([(doc_id, start, ids[:4 * self.length], tokens)])
            ids, start = ids[4 * self.length:], start + self.length
        while ids:
            need = len(ids) // 4
            fits = [w for w in self.open if w[0] + need <= self.length]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                need = self.length - window[0]
            window[0] += need
            window[1].append((doc_id, start, ids[:4 * need], tokens))
            ids, start = ids[4 * need:], start + need
            if window[0] == self.length:
                self.open = [w for w in self.open if w is not window]
                yield self._emit(window[1])

    def rest(self) -> Iterator[list[tuple]]:
        for _, pieces in self.open:
            yield self._emit(pieces)


def _frame(rows: list[tuple], task: int, keep_ids: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    if not keep_ids:
        out["ids"] = None
    return out.assign(task=task)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"]]


def _first_id(level: int, task: int) -> int:
    return (level << 56) | (task << 28)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         windows: int = WINDOWS, fan_in: int = FAN_IN, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    tail = end.to_bytes(4, "little")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = _PIECE.format(id=dict(rows.dtypes)["doc_id"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        packer, ids_of = Packer(length, windows, _first_id(0, task)), encoder(path).encode
        for batch in batches:
            ids, texts = list(batch["doc_id"]), list(batch["text"])
            for at in range(0, len(ids), 500):
                done: list[tuple] = []
                for doc_id, blob in zip(ids[at:at + 500], ids_of(texts[at:at + 500])):
                    blob += tail
                    for pieces in packer.place(doc_id, 0, blob, len(blob) // 4):
                        done += pieces
                if done:
                    yield _frame(done, task, keep_ids=False)
        yield _frame([p for pieces in packer.rest() for p in pieces], task, keep_ids=True)

    def merge(level: int):
        def one(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
            task = int(key[0])
            packer, done = Packer(length, windows, _first_id(level, task)), []
            held = held.sort_values(["sequence_id", "offset"])
            for doc_id, start, tokens, ids in zip(held["doc_id"], held["start"], held["doc_tokens"], held["ids"]):
                for pieces in packer.place(doc_id, int(start), bytes(ids), int(tokens)):
                    done += pieces
            left = [p for pieces in packer.rest() for p in pieces]
            return pd.concat([_frame(done, task, False), _frame(left, task, True)])
        return one

    level, at = 0, pinned(rows.mapInPandas(first, schema))
    closed = [at.where("ids is null")]
    tasks = (at.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        level, tasks = level + 1, -(-tasks // fan_in)
        group = F.floor(F.col("task") / fan_in).alias("into")
        at = pinned(at.where("ids is not null").groupBy(group).applyInPandas(merge(level), schema))
        closed.append(at.where("ids is null"))
    result = at.where("ids is not null")
    for part in closed:
        result = result.unionByName(part)
    return result.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
