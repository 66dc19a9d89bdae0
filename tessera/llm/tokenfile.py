"""Token-id output: Simple-8b words in block tables, written and read by Spark.

A 64-bit word holds a selector in its top four bits and 60 bits of payload: ``COUNTS[s]`` ids of ``WIDTHS[s]``
bits each. Selector 0 is an escape: its payload is an index into the block's list of values of over 60 bits.
A block holds whole documents, with its words, the documents' ids and lengths, and the ids before it in its shard,
so blocks decode on their own and each selector's words decode at once. The table is Parquet, written through
Spark's committer: any store that Spark can write serves, and a lost executor leaves no half-written file.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 2
BLOCK_IDS = 1 << 17
CACHE_WORDS = 300_000
#: Bytes of text whose words are encoded together.
SLICE_BYTES = 8 << 20
# Ids to a word and bits to an id, by selector; selector 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_SCHEMA = "shard int, block int, ids_before long, n_ids long, doc_ids array<long>, doc_lens array<long>, escapes array<long>, words binary"


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Ids (unsigned, any size to 63 bits) as Simple-8b words, each as full as it can be, and the escaped values."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return b"", []
    need = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    top = {1: np.concatenate([need, np.zeros(60, np.uint8)])}

    def widest(count: int) -> np.ndarray:
        """The most bits that any of the next ``count`` ids needs, from two overlapping runs of half the length."""
        if count not in top:
            half = max(c for c in (1, 2, 4, 8, 15, 30) if c < count and 2 * c >= count)
            a, lag = widest(half), count - half
            top[count] = np.concatenate([np.maximum(a[:-lag], a[lag:]), a[-lag:]])
        return top[count]

    pick = np.zeros(n, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        pick[widest(COUNTS[s])[:n] <= WIDTHS[s]] = s
    # a word's start leads to the next one; jumps of doubled length reach as many starts again in every turn
    jump = np.append(np.minimum(np.arange(n, dtype=np.int32) + np.array(COUNTS, dtype=np.int32)[pick], n), n)
    first = np.zeros(1, np.int32)
    while first[-1] < n:
        first = np.concatenate([first, jump[first]])
        jump = jump[jump]
    first = first[first < n]
    chosen = pick[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    escapes: list[int] = []
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            escapes = ids[first[mine]].tolist()
            words[mine] |= np.arange(len(escapes), dtype=np.uint64)
            continue
        at, load = first[mine], np.zeros(int(mine.sum()), np.uint64)
        for k in range(COUNTS[s]):
            load |= padded[at + k] << np.uint64(k * WIDTHS[s])
        words[mine] |= load
    return words.astype("<u8").tobytes(), escapes


def unpack(words: bytes, escapes: list[int], n: int) -> np.ndarray:
    """The ``n`` ids of :func:`pack`, one selector at a time."""
    packed = np.frombuffer(words, dtype="<u8")
    chosen = (packed >> np.uint64(60)).astype(np.intp)
    counts = np.array(COUNTS)[chosen]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        load, at = packed[mine] & np.uint64((1 << 60) - 1), first[mine]
        if s == 0:
            out[at] = np.array(escapes, dtype=np.uint64)[load.astype(np.intp)]
            continue
        keep = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[at + k] = (load >> np.uint64(k * WIDTHS[s])) & keep
    return out[:n]


#: A word of Latin letters with signs behind it. The tokenizer splits such signs from letters and lowers letters.
_PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!#$%&()*+,\-./:;<=>?@\[\]^_`{|}~\\]*)$"
_PROBES = ("a", "word", "tokenization", "élève", "straße", "ÿþñ", "q" * 40)


def _byte_letters() -> dict[int, str]:
    """The rule by which byte-level tokenizers write bytes as letters: printable Latin-1 stays, others follow from 256."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in stay else next(rest)) for b in range(256)}


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins across white space; bounded caches hold what was seen before.

    The words of a batch are dictionary-encoded in Arrow; words of Latin letters are cut into lower-cased letters and
    signs, each with a dictionary of its own, so Python sees distinct pieces only. ``plain`` has letters, ``known``
    signs and all other words as they stand.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.known, self.plain = Tokenizer.from_file(path), words, {}, {}
        model, letters = self.tokenizer.model, _byte_letters()

        def one(word: str) -> bytes:
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
            return array("I", [t.id for t in model.tokenize(raw)]).tobytes()

        #: Ids of one word of lower-cased letters straight from the model, where that gives what the whole tokenizer gives.
        self.one = one if all(one(w) == self._ids(w).tobytes() for w in _PROBES) else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, and the number of ids of each text."""
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = parts.flatten().dictionary_encode()
        flat, sizes = self.words_of(coded.dictionary)
        flat, sizes = np.append(flat, np.uint32(end_id)), np.append(sizes, 1)
        words = np.insert(coded.indices.to_numpy(), bounds[1:], len(sizes) - 1)
        ids, lens = _take(flat, sizes, words)
        ends = np.cumsum(lens)[bounds[1:] + np.arange(len(bounds) - 1)]
        return ids, np.diff(ends, prepend=0)

    def words_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each has."""
        if len(self.known) > self.words:
            self.known = {}
        if len(self.plain) > 3 * self.words:
            self.plain = {}
        cut = pc.extract_regex(words, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        cores = pc.utf8_lower(pc.struct_field(cut.drop_null(), "core")).dictionary_encode()
        tails = pc.struct_field(cut.drop_null(), "tail").dictionary_encode()
        letters, signs = cores.dictionary.to_pylist(), tails.dictionary.to_pylist()
        others = words.filter(pa.array(~plain)).to_pylist()
        new = [w for w in letters if w not in self.plain]
        self.plain.update(zip(new, map(self.one, new)) if self.one else self._learn(new))
        self.known.update(self._learn([w for w in (*signs, *others) if w not in self.known]))
        pieces = [*map(self.plain.get, letters), *map(self.known.get, signs), *map(self.known.get, others), b""]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        pick = np.empty((len(words), 2), np.int64)
        pick[plain, 0] = cores.indices.to_numpy()
        pick[plain, 1] = tails.indices.to_numpy() + len(letters)
        pick[~plain, 0] = len(letters) + len(signs) + np.arange(len(others))
        pick[~plain, 1] = len(pieces) - 1
        ids, lens = _take(np.frombuffer(b"".join(pieces), dtype="<u4"), sizes, pick.ravel())
        return ids, lens.reshape(-1, 2).sum(axis=1)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Encode distinct words as one text; a token belongs to the word in which it starts."""
        got = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        raw = np.array(got.ids, dtype="<u4").tobytes()
        starts = np.cumsum([0, *(len(w) + 1 for w in new)])
        cuts = (4 * np.searchsorted([a for a, _ in got.offsets], starts)).tolist()
        return {word: raw[a:b] for word, a, b in zip(new, cuts, cuts[1:])}


def _take(flat: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the ``picked`` runs, and their lengths; ``flat`` has runs of ``sizes`` values in a row."""
    lens = sizes[picked]
    shift = (np.cumsum(sizes) - sizes)[picked] - (np.cumsum(lens) - lens)
    return flat[np.repeat(shift, lens) + np.arange(int(lens.sum()))], lens


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for a Python worker, so that later tasks find its words."""
    return WordEncoder(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
        yield at, stop
        at = stop


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, shards: int | None = None) -> None:
    """Encode every text, end it with ``end_id`` and write the blocks to ``path`` in ascending id order.

    Null texts count as empty (only the end id is written). Rows without an id come first; rows that share an id
    are ordered by their text. An empty table writes an empty one. ``tokenizer`` must be readable on executors.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = {"doc_ids", "doc_lens", "escapes"}
    fields = [(c, pa.list_(pa.int64()) if c in lists else pa.binary() if c == "words" else pa.int32() if c in ("shard", "block") else pa.int64()) for c in (f.split(" ")[0] for f in _SCHEMA.split(", "))]
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard = encoder_of(tokenizer), TaskContext.get().partitionId()
        block, before, held, owners, lens, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, held, owners, lens, size
            ids = np.concatenate(held)
            words, escapes = pack(ids)
            row = [shard, block, before, len(ids), owners, lens, escapes, words]
            block, before, held, owners, lens, size = block + 1, before + len(ids), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, (_, t) in zip(row, fields)], schema=schema)

        for batch in batches:
            for a, b in _slices(batch.column("t")):
                ids, counts = encoder.texts(batch.column("t").slice(a, b - a), end_id)
                names, ends, at, row = batch.column("id").slice(a, b - a).to_pylist(), np.cumsum(counts), 0, 0
                while row < len(names):
                    # documents up to the one that fills the block
                    stop = min(len(names), int(np.searchsorted(ends, at + block_ids - size)) + 1)
                    held.append(ids[at : ends[stop - 1]])
                    owners += names[row:stop]
                    lens += counts[row:stop].tolist()
                    size, at, row = size + int(ends[stop - 1]) - at, int(ends[stop - 1]), stop
                    if size >= block_ids:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "t")
    rows.mapInArrow(encode, _SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: ``doc_id, start, n_tokens, ids_crc32``, each from its decoded ids.

    ``start`` counts the ids of all documents before it: of earlier shards (a table with one row per shard),
    of earlier blocks of the shard, and of earlier documents of the block.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", offset.alias("offset"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for shard, before, n, owners, lens, escapes, words in part.itertuples(index=False, name=None):
                ids = unpack(words, list(escapes), n).astype("<u4")
                ends = np.cumsum(np.asarray(lens, dtype=np.int64))
                starts = ends - lens
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pd.DataFrame({"shard": shard, "doc_id": pd.array(list(owners), dtype="Int64"), "at": starts + before, "n_tokens": lens, "ids_crc32": crc})

    rows = blocks.select("shard", "ids_before", "n_ids", "doc_ids", "doc_lens", "escapes", "words").mapInPandas(decode, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(totals, "shard").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
