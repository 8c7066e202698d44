"""Token ids as length-delimited binary records with a separate offset index.

Texts are range-partitioned and sorted by doc_id; each task encodes its share and writes one file of frames:

    u64 length | u32 masked crc32(length) | payload | u32 masked crc32(payload)

    payload: u8 flags (1: has a doc_id, 2: ids take four bytes, else two) | i64 doc_id | ids, little-endian

The index (Parquet, next to the files) holds file, byte offset, frame length and the running number of ids, so
that a reader can fetch any record alone, in any order. A file gets its final name when it is whole; its name and
bytes depend on the partition alone, so a task that runs twice writes the same file again.

Cases: null text is the empty text (a record with the end id alone); a null doc_id sorts first and is read back as
null; repeated doc_ids and repeated rows give a record each, in order of their text's hash; an empty table
gives an empty index; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm.common import WORKER_HELD, filesystem, partitions

HAS_ID, WIDE = 1, 2
# Words whose ids a process remembers; when full, those met once are forgotten, which changes speed alone.
REMEMBERED_WORDS = 1_000_000
# ASCII marks but for the apostrophe, which may begin a piece with letters, and those of special tokens' names.
MARKS = ".,;:!?)(]}[{\"-_/*$%&#@+=~^`\\"
# Letters whose normal or lower form ends in what is none, so that a mark behind them is of the same piece.
NO_END = "\u0130\u0958-\u095f\u09dc-\u09df\u0a33-\u0a5e\u0b5c\u0b5d\u0f43-\u0f69\ufb1d-\ufb4e"
# The mark comes first, so that the search goes by it; what stands before it is looked at then.
PARTED = re.compile(r"([" + re.escape(MARKS) + r"](?<=[^\W\d_" + NO_END + r"].)[" + re.escape(MARKS) + r"]*)(?= |$)")
# Characters beyond those whose lower case is one character and which no normalisation joins or changes.
UNSAFE = re.compile("[^\\x00-\\u012f\\u0131-\\u024f\\u2000-\\u206f\\u20ac]")
# Characters of the texts encoded together; a longer text is encoded alone.
TOGETHER = 4_000_000
INDEX = "doc_id long, part int, file string, ordinal long, offset long, length long, n_tokens long, first_token long"
RECORDS = "doc_id long, part int, ordinal long, n_tokens long, first_token long, ids_crc32 long"


class CorruptRecord(ValueError):
    """A frame whose length or checksum does not fit."""


def masked(data: bytes) -> int:
    """crc32, rotated right by 15 bits plus a constant, so that a checksum of checksums stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises ``CorruptRecord`` unless all of it is sound."""
    if len(data) < 16:
        raise CorruptRecord("frame cut short")
    head, (head_sum,) = data[:8], struct.unpack_from("<I", data, 8)
    (length,) = struct.unpack("<Q", head)
    if masked(head) != head_sum or len(data) != length + 16:
        raise CorruptRecord("length")
    payload = data[12:-4]
    if masked(payload) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise CorruptRecord("payload")
    return payload


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<Bq", (doc_id is not None) * HAS_ID + wide * WIDE, doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return doc_id if flags & HAS_ID else None, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9)


class WordEncoder:
    """Ids of whole texts, word by word.

    For tokenizers that never join what a space or line feed parts, as those with a splitting pre-tokenizer and
    dropped white space: the ids of a text are those of its pieces in a row, and each piece is encoded once.
    """

    def __init__(self, tokenizer_json: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # ids that end a word, by the mark that the vocabulary gives them
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # words by number; the ids of word i are ids[bounds[i] : bounds[i + 1]]; the first is the empty word
        self.numbers: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, dtype)
        self.bounds = np.zeros(2, np.int64)
        self.again = np.ones(1, bool)  # words met in more than one call since the memory was last thinned out

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each)"""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], self.ids.dtype), np.array([len(ids) for ids in got], np.int64)

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, in one go, told apart by the ids that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.ids.dtype)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(words) and cut[-1] == len(ids):
            return ids, np.diff(cut, prepend=0)
        return self._encode_each(words)

    def _learn(self, words: list[str]) -> None:
        letters, other = [], []
        for w in words:
            (letters if w.isalpha() else other).append(w)
        found = [self._encode_letters(letters[at : at + 5_000]) for at in range(0, len(letters), 5_000)]
        found.append(self._encode_each(other))
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        self.numbers.update(zip([*letters, *other], range(len(self.numbers), len(self.numbers) + len(words)), strict=True))
        self.ids = np.concatenate((self.ids, ids))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
        self.again = np.concatenate((self.again, np.zeros(len(words), bool)))

    def _gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, where each word's ids end)"""
        start = self.bounds[words]
        size = self.bounds[words + 1] - start
        end = np.cumsum(size)
        return self.ids[np.repeat(start - end + size, size) + np.arange(size.sum())], end

    def _forget(self) -> None:
        """Keeps the words met again alone."""
        self.again[0] = True
        kept = np.flatnonzero(self.again)
        words = list(self.numbers)  # in the order of their numbers
        self.numbers = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.ids, end = self._gather(kept)
        self.bounds = np.concatenate((np.zeros(1, np.int64), end))
        self.again = np.zeros(len(kept), bool)

    def encode(self, texts: list[str]) -> list[bytes]:
        # names of special tokens keep their case
        low = (t if "<|" in t or not t.isascii() and UNSAFE.search(t) else t.lower() for t in texts)
        # marks behind a letter are a piece of their own: parted, far fewer words differ
        split = pc.split_pattern(pa.array([PARTED.sub(r" \1", t.replace("\n", " ")) for t in low], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.numbers) > REMEMBERED_WORDS:
            self._forget()
        number = np.array([self.numbers.get(w, -1) for w in words], np.int64)
        fresh = number < 0
        self.again[number[~fresh]] = True
        if fresh.any():
            new = [words[i] for i in np.flatnonzero(fresh).tolist()]
            self._learn(new)
            number[fresh] = [self.numbers[w] for w in new]
        ids, end = self._gather(number[coded.indices.to_numpy()])
        cut = (np.concatenate((np.zeros(1, np.int64), end))[split.offsets.to_numpy()] * ids.itemsize).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class WholeEncoder:
    """Ids of whole texts in one call each, for any tokenizer."""

    def __init__(self, tokenizer_json: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = dtype

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder_of(tokenizer_json: str, dtype: str) -> WordEncoder | WholeEncoder:
    """The encoder of this Python process: workers serve many tasks, and keep the words they have met."""
    key = (tokenizer_json, dtype)
    if key not in WORKER_HELD:
        WORKER_HELD.clear()
        WORKER_HELD[key] = (WordEncoder if splits_words(tokenizer_json) else WholeEncoder)(tokenizer_json, dtype)
    return WORKER_HELD[key]


def splits_words(tokenizer_json: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space and cuts between letters and marks, as ``WordEncoder`` needs."""
    import json

    model = json.loads(tokenizer_json)
    steps = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [model.get("pre_tokenizer") or {}]
    norms = (model.get("normalizer") or {}).get("normalizers") or [model.get("normalizer") or {}]
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    cuts = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in pattern and r"\p{L}]+" in pattern
    return cuts and {n.get("type") for n in norms} <= {"NFC", "Replace", "Lowercase"} and any(n.get("type") == "Lowercase" for n in norms)


def together(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of texts in a row that have ``most`` characters or are one text."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def write(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 1, n_files: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``, ascending by doc_id; returns the index, also kept there.

    ``n_files``: range partitions; by default Spark decides, joining small ones.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:  # a few megabytes, read by the driver, sent to each executor once
        model = f.read()
    sent = spark.sparkContext.broadcast(model)
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1) > 65_536
    dtype = "<u4" if wide else "<u2"
    end = np.array([end_id], dtype).tobytes()
    width = len(end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value, dtype)
        store, root = filesystem(folder)
        task = TaskContext.get()
        part, name = task.partitionId(), f"part-{task.partitionId():06d}.rec"
        draft, out = f"{root}/.{name}-{task.taskAttemptId()}", None
        ordinal = offset = first = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(draft)
            rows = []
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at, to in together(texts, TOGETHER):
                for doc_id, text_ids in zip(doc_ids[at:to], encoder.encode(texts[at:to]), strict=True):
                    ids = text_ids + end
                    record = frame(pack(doc_id, ids, wide))
                    out.write(record)
                    rows.append((doc_id, part, name, ordinal, offset, len(record), len(ids) // width, first))
                    ordinal, offset, first = ordinal + 1, offset + len(record), first + len(ids) // width
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if out is not None:
            out.close()
            store.move(draft, f"{root}/{name}")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(*([n_files] if n_files else []), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(encode, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def starts(index: DataFrame) -> DataFrame:
    """part and the number of ids in all files before it: one row per file, as many as write tasks."""
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record fetched from the files through the index, lengths and checksums verified.

    Returns doc_id, start (ids of all records before it), n_tokens, ids_crc32 (of the ids as four bytes each).
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, file = r["file"], store.open_input_file(f"{root}/{r['file']}")
                payload = unframe(file.read_at(r["length"], r["offset"]))
                doc_id, ids = unpack(payload)
                if doc_id != r["doc_id"] or len(ids) != r["n_tokens"]:
                    raise CorruptRecord(f"{name} at {r['offset']}: not the record of the index")
                rows.append((doc_id, r["part"], r["ordinal"], len(ids), r["first_token"], zlib.crc32(ids.astype("<u4").tobytes())))
            if rows:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                names = [x.split()[0] for x in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    runs = index.repartition(partitions(spark), "part", F.floor(F.col("ordinal") / 2_000)).sortWithinPartitions("part", "offset")
    records = runs.mapInArrow(fetch, RECORDS)
    # one row per file: bounded by the number of write tasks
    joined = records.join(F.broadcast(starts(index)), "part")
    return joined.select("doc_id", (F.col("base") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")
