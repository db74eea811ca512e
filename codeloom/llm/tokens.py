"""Encoding a corpus with a public byte-level tokenizer, each shared passage once.

Texts are cut where a rolling hash over the last bytes says so, so equal passages are cut alike wherever they stand.
Equal chunks are encoded once for the whole corpus. A cut at a place where the tokenizer's words always end (between a
visible ASCII character and white space) is exact as it is; at any other cut the two sides are repaired: the text around
the cut is encoded again, from the nearest certain word end before it to the nearest one after it, reaching as far into
the chunks (and over further cuts) as it takes. The ids then agree with those of the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import heavy_light_join
from codeloom.session import Scratch

#: The folder of the vocabulary files; its place is a parameter, the files are no part of this repository.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How a byte-level tokenizer of this kind splits text into words before it merges bytes (a fixed value of its format).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes the rolling hash sees, one cut in so many places, least bytes of a chunk, bytes after which any place will do.
WINDOW, EVERY, LEAST, FAR = 16, 64, 128, 1024
#: A chunk that makes up more than this share of all chunks is joined by broadcast; at most its inverse are.
HEAVY_SHARE = 0.001

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint32)


@lru_cache(maxsize=2)
def tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


#: White space of more characters than that is split into words here, for the tokenizer's own splitter runs out of stack.
LONG_SPACE = 2_000
_LONG = regex.compile(r"\p{White_Space}{%d}" % LONG_SPACE)
_WORD = regex.compile(WORDS.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def encode(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """The ids of a text, however long its runs of white space."""
    if not _LONG.search(text):
        return encoding.encode_ordinary(text)
    return [i for word in _WORD.findall(text) for i in encoding._core_bpe.encode_single_piece(word.encode())]


def places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the rolling hash would cut, and which of these places are certain word ends. A place depends on the WINDOW bytes
    before it only, so that texts may stand one after the other in ``data`` if none is cut that early."""
    b = np.frombuffer(data, dtype=np.uint8)
    # The hash is the sum over k of gear(byte k places back) << k; each step doubles the window.
    rolled, seen = _GEAR[b], 1
    while seen < WINDOW:
        rolled[seen:] += rolled[:-seen] << np.uint32(seen)
        seen *= 2
    visible = (b > 0x20) & (b < 0x7F)
    certain = np.zeros(len(b), dtype=bool)
    certain[1:] = ((b[1:] == 0x20) | ((b[1:] >= 0x09) & (b[1:] <= 0x0D))) & visible[:-1]
    begins = (b & 0xC0) != 0x80  # the first byte of a character
    # A cut before byte i depends on the bytes before it only. Certain word ends are about one place in six.
    before = np.zeros(len(b), dtype=np.uint32)
    before[1:] = rolled[:-1] >> np.uint32(16)  # the upper bits have seen the whole window
    hit = np.flatnonzero((certain & (before % np.uint32(EVERY // 4) == 0)) | (begins & (before % np.uint32(EVERY * 4) == 1)))
    return hit, certain[hit]


def _ends(size: int, hit: list[int], certain: list[bool]) -> list[tuple[int, bool]]:
    """The cuts of a text of so many bytes among the places found in it: (offset, whether it is certain), the end last."""
    out, last = [], 0
    for i, sure in zip(hit, certain):
        if i - last < LEAST or i >= size:
            continue
        if sure or i - last > FAR:
            out.append((i, sure))
            last = i
    out.append((size, True))
    return out


def cuts(data: bytes) -> list[tuple[int, bool]]:
    """Where to cut one text: (offset, whether the cut is at a certain word end), the end of the data last."""
    hit, certain = places(data) if len(data) > LEAST else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
    return _ends(len(data), hit.tolist(), certain.tolist())


CHUNKS = "uid long, doc_id long, seq int, key binary, text string, sure boolean, repair boolean"


#: Bytes of texts whose cuts are looked for at once.
AT_ONCE = 1_000_000


def _chunk(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        begin = 0
        while begin < batch.num_rows:
            size, end, group = 0, begin, []
            while end < batch.num_rows and size < AT_ONCE:
                group.append((batch.column(2)[end].as_py() or "").encode())
                size, end = size + len(group[-1]), end + 1
            yield _batch(_chunks_of(batch.column(0)[begin:end].to_pylist(), batch.column(1)[begin:end].to_pylist(), group))
            begin = end


def _chunks_of(uids: list, doc_ids: list, texts: list[bytes]) -> list[list]:
    columns: list[list] = [[] for _ in range(7)]
    hit, certain = places(b"".join(texts))
    bounds = np.cumsum([0] + [len(t) for t in texts])
    at = np.searchsorted(hit, bounds)
    for k, (uid, doc_id, data) in enumerate(zip(uids, doc_ids, texts)):
        ends = _ends(len(data), (hit[at[k] : at[k + 1]] - bounds[k]).tolist(), certain[at[k] : at[k + 1]].tolist())
        repair = not all(sure for _, sure in ends)
        start = 0
        for seq, (end, sure) in enumerate(ends):
            part = data[start:end]
            start = end
            for column, value in zip(columns, (uid, doc_id, seq, xxhash.xxh3_128_digest(part), part, sure, repair)):
                column.append(value)
    return columns


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    arrays[4] = arrays[4].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, names=["uid", "doc_id", "seq", "key", "text", "sure", "repair"])


def _encoder(folder: str, vocabulary: str):
    def run(batches: Iterable[pa.RecordBatch]):
        encoding = tokenizer(folder, vocabulary)
        for batch in batches:
            ids = pa.array([encode(t, encoding) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), ids], names=["key", "n", "ids"])

    return run


_KINDS = regex.compile(r"(\p{White_Space})|(\p{L})|(\p{N})", regex.DOTALL)


def _kind(c: str) -> int:
    found = _KINDS.match(c)
    return 4 if found is None else found.lastindex


def _word_end(text: str, i: int) -> bool:
    """Whether a word of the tokenizer certainly ends between ``text[i-1]`` and ``text[i]``, whatever surrounds them: the
    kind of the characters changes, and it does not change from white space, which may go either way, or after an
    apostrophe, which may begin a word with what follows."""
    a, b = _kind(text[i - 1]), _kind(text[i])
    return a != 1 and a != b and text[i - 1] != "'"


def join(parts: list[tuple[list[int], bool]], encoding: tiktoken.Encoding) -> list[int]:
    """The ids of a text from those of its chunks, given with whether the cut after each is at a certain word end."""
    done: list[int] = []
    i = 0
    while i < len(parts):
        ids, sure = parts[i]
        i += 1
        if sure or i == len(parts):
            done.extend(ids)
            continue
        left, right = list(ids), list(parts[i][0])
        right_sure = parts[i][1]
        take, give, more = 8, 8, 1
        while True:
            take, give = min(take, len(left)), min(give, len(right))
            a, b = encoding.decode_bytes(left[len(left) - take :]), encoding.decode_bytes(right[:give])
            skip = 0 if take == len(left) else next((k for k, c in enumerate(a) if c & 0xC0 != 0x80), len(a))
            text, at = (a[skip:] + b).decode(errors="ignore"), len(a[skip:].decode(errors="ignore"))
            # Bounds of the repaired stretch: certain word ends that are also ends of tokens on their side.
            lo = _bound(text, a, skip, left[len(left) - take :], encoding, back=True, at=at, whole=take == len(left))
            hi = _bound(text, b, 0, right[:give], encoding, back=False, at=at, whole=give == len(right))
            if lo is not None and hi is not None:
                (keep, begin), (drop, end) = lo, hi
                done.extend(left[: len(left) - take + keep])
                middle = encode(text[begin:end], encoding)
                parts[i] = (middle + right[drop:], right_sure)
                break
            if lo is None and take < len(left):
                take *= 2
                continue
            if hi is None and give < len(right):
                give *= 2
                continue
            # No certain word end in all of the chunk: the two are one stretch, which goes on with the next cut.
            if hi is None and i + 1 < len(parts) and not right_sure:
                stop = min(i + more, len(parts) - 1)
                while i < stop and not right_sure:
                    i += 1
                    right.extend(parts[i][0])
                    right_sure = parts[i][1]
                more *= 2
                continue
            both = encoding.decode_bytes(left + right).decode()
            parts[i] = (encode(both, encoding), right_sure)
            break
    return done


def _bound(text, raw, skip, ids, encoding, back, at, whole):
    """The end of the repaired stretch on one side: (tokens of ``ids`` before it, offset in ``text``), or None if no
    token end of that side is a certain word end. The outer end of a whole chunk counts as one, for its chunk ends there."""
    ends = np.cumsum([0] + [len(encoding.decode_single_token_bytes(t)) for t in ids])
    first = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80  # bytes that begin a character
    before = np.concatenate([[0], np.cumsum(first)])
    for k in range(len(ends) - 1, -1, -1) if back else range(len(ends)):
        offset = int(ends[k])
        if offset < skip or (offset < len(raw) and not first[offset]):
            continue
        where = int(before[offset] - before[skip]) + (0 if back else at)
        if whole and k == (0 if back else len(ids)):
            return k, where
        if 0 < where < len(text) and (where < at if back else where > at) and _word_end(text, where):
            return k, where
    return None


def _assemble(folder: str, vocabulary: str):
    def run(batches: Iterable[pd.DataFrame]):
        encoding = tokenizer(folder, vocabulary)
        for batch in batches:
            out = []
            for parts in batch["parts"]:
                out.append(join([(np.asarray(p["ids"]).tolist(), bool(p["sure"])) for p in parts], encoding))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": out})

    return run


def _encoded_chunks(documents: DataFrame, folder: str, vocabulary: str) -> tuple[DataFrame, DataFrame, list[bytes]]:
    """The chunks of all texts, the ids of each distinct chunk, and the keys of the most frequent ones."""
    scratch = Scratch(documents.sparkSession, "tokens")
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks, found = scratch.measured(rows.mapInArrow(_chunk, CHUNKS), rows=F.count(F.lit(1)))
    uses = chunks.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    encoded = scratch.save(uses.select("key", "n", "text").mapInArrow(_encoder(folder, vocabulary), "key binary, n long, ids array<int>"))
    limit = max(1, int(found["rows"] * HEAVY_SHARE))
    heavy = [bytes(r[0]) for r in encoded.where(F.col("n") > limit).select("key").collect()]  # at most 1 / HEAVY_SHARE
    return chunks, encoded, heavy


def _repaired(chunks: DataFrame, encoded: DataFrame, heavy: list[bytes], folder: str, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``ids`` of the texts with uncertain cuts: only these leave the JVM to be repaired."""
    found = heavy_light_join(chunks.where("repair").select("uid", "doc_id", "seq", "sure", "key"), encoded.select("key", "ids"), "key", heavy)
    whole = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "sure", "ids"))).alias("parts"))
    return whole.select("doc_id", "parts").mapInPandas(_assemble(folder, vocabulary), "doc_id long, ids array<int>")


def encode_corpus(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` (list of int) of every row of ``documents``: the ids of its whole ``text``, no special tokens.

    Null and empty texts give the empty list; text that looks like a special token is plain text. Every row comes out
    once, repeated rows and null ids too. An empty table gives no rows; other columns are not read.
    """
    chunks, encoded, heavy = _encoded_chunks(documents, folder, vocabulary)
    # The ids of a text all of whose cuts are certain are those of its chunks, one after the other.
    found = heavy_light_join(chunks.where("not repair").select("uid", "doc_id", "seq", "key"), encoded.select("key", "ids"), "key", heavy)
    whole = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten("parts.ids").alias("ids")).unionByName(_repaired(chunks, encoded, heavy, folder, vocabulary))


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row of ``documents``, as many as ``encode_corpus`` has ids. Where all cuts of a text
    are certain the numbers of its chunks are added, and no ids are gathered."""
    chunks, encoded, heavy = _encoded_chunks(documents, folder, vocabulary)
    sizes = encoded.select("key", F.size("ids").cast("long").alias("size"))
    found = heavy_light_join(chunks.where("not repair").select("uid", "doc_id", "key"), sizes, "key", heavy)
    whole = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sum("size").alias("n_tokens")).select("doc_id", "n_tokens")
    return whole.unionByName(_repaired(chunks, encoded, heavy, folder, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens")))
