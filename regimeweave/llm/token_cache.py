"""Token counts behind a digest cache: stored counts are joined, only distinct misses are encoded and appended."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeweave.llm import common as C

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
HOT_KEYS = 10_000
WINDOW = 1 << 20  # characters of a text that are taken apart at a time
BATCH = 1 << 20
MEMO = 1_000_000  # parts whose counts a task keeps
MEMO_CHARS = 64
ENTRY = "digest binary, n_tokens bigint"

# A byte-level pre-token is white space, or one optional space and a run of one kind. So it never holds white space
# behind a visible character, and neither side of such a place is read for the other. Likewise a run of letters ends before a mark.
VISIBLE = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PART = re.compile(rf"(?<=[{VISIBLE}])(?=[ \n])")
CUT = re.compile(rf"(?<=[{VISIBLE}])[ \n]|(?<=[A-Za-z\u4e00-\u9fff\u3041-\u3096\u30a1-\u30fa])[.,\u3002\u3001\uff0c\uff01\uff1f]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Counter:
    """Number of ids that the library of a tokenizer file gives for a text; sent to the tasks by value."""

    def __init__(self, path: str):
        self.kind = "tokenizers" if path.endswith(".json") else "sentencepiece"
        self.content = Path(path).read_bytes()
        # what else the counts depend on
        self.version = hashlib.sha256(f"{self.kind} {version(self.kind)} plain\n".encode() + self.content).hexdigest()
        self.cuts = False
        if self.kind == "tokenizers":
            spec = json.loads(self.content)
            first = spec.get("pre_tokenizer") or {}
            plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not spec.get("normalizer")
            added = [t for t in spec.get("added_tokens", []) if CUT.search(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]]
            self.cuts = bool(plain and not added)
        self.encoder = None
        self.memo: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"encoder": None, "memo": {}}

    def windows(self, text: str, size: int = WINDOW) -> list[str]:
        """Parts of a long text whose counts add up to the text's; one part if the file's rules do not promise that."""
        if not self.cuts or len(text) <= size:
            return [text]
        parts, at = [], 0
        while len(text) - at > size:
            cut = CUT.search(text, at + size)
            if cut is None:
                break
            parts.append(text[at : cut.start()])
            at = cut.start()
        return [*parts, text[at:]]

    def count(self, parts: list[str]) -> list[int]:
        if self.encoder is None:
            if self.kind == "tokenizers":
                import os

                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.encoder = Tokenizer.from_str(self.content.decode())
                self.encoder.no_padding()
                self.encoder.no_truncation()
            else:
                from sentencepiece import SentencePieceProcessor

                self.encoder = SentencePieceProcessor(model_proto=self.content)
        if self.kind == "tokenizers":
            return [len(e) for e in self.encoder.encode_batch_fast(parts, add_special_tokens=False)]
        return [len(ids) for ids in self.encoder.encode(parts, num_threads=1)]

    def sums(self, windows: list[str]) -> list[int]:
        """Counts of the windows; a part that several of them hold, a word and the space before it, is encoded once."""
        if not self.cuts:
            return self.count(windows)
        parts = [PART.split(w) for w in windows]
        new = list(set().union(*parts) - self.memo.keys())
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(set().union(*parts))
        known = dict(zip(new, self.count(new), strict=True))
        self.memo.update(known)
        out = [sum(map(self.memo.__getitem__, p)) for p in parts]
        for part in new:
            if len(part) > MEMO_CHARS:
                del self.memo[part]
        return out

    def totals(self, texts: Iterator[str]) -> Iterator[int]:
        """Counts of the texts in their order; about ``BATCH`` characters are encoded at a time."""
        windows, of, size, sums = [], [], 0, []
        for text in texts:
            sums.append(0)
            for window in self.windows(text):
                windows.append(window)
                of.append(len(sums) - 1)
                size += len(window)
                if size >= BATCH:
                    for k, c in zip(of, self.sums(windows), strict=True):
                        sums[k] += c
                    yield from sums[:-1]
                    sums, windows, of, size = sums[-1:], [], [], 0
        for k, c in zip(of, self.sums(windows) if windows else [], strict=True):
            sums[k] += c
        yield from sums


def entries(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` stored for one tokenizer version, each digest once; creates an empty store."""
    path = f"{cache.rstrip('/')}/version={version}"
    spark.createDataFrame([], ENTRY).write.mode("ignore").parquet(path)
    return spark.read.schema(ENTRY).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_misses(docs: DataFrame, groups: DataFrame, cache: str, counter: Counter) -> None:
    """Encodes one row of every digest of ``groups`` that the store lacks, and appends the counts.

    ``groups`` holds ``digest, first_id`` of ``docs``. A miss is represented by its smallest id (null if all are),
    so only one of its rows brings its text along, however many copies there are; of rows that share both
    id and text a task encodes one, and the store folds the rest on reading. A text moves once at most, and not
    at all where the misses are few enough for Spark to broadcast them.
    """
    spark = docs.sparkSession
    known = entries(spark, cache, counter.version)
    misses = groups.join(known, "digest", "left_anti").select(F.col("digest").alias("_digest"), F.col("first_id").alias("_id"))
    texts = docs.select("doc_id", C.text_of().alias("text")).withColumn("digest", digest_of("text"))
    todo = texts.join(misses, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, texts = batch.column(0).to_pylist(), batch.column(1)
            new = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
            counts = counter.totals(texts[i].as_py() for i in new)
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), pa.array(list(counts), pa.int64())], ["digest", "n_tokens"])

    C.map_arrow(todo, run, ENTRY).write.mode("append").parquet(f"{cache.rstrip('/')}/version={counter.version}")


def digest_of(text: str) -> F.col:
    return F.unhex(F.sha2(F.col(text), 256))


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row: the ids that the tokenizer file's library gives for its whole text.

    No begin, end or padding; special strings inside a text count as the library's default has it. The
    content is normalised only as far as no count depends on it: null is the empty text. ``cache`` is a
    folder of Parquet files, one subfolder for each digest of library, its version and the tokenizer file.
    Stored counts are never changed: files are only added, so a run that breaks off leaves right rows
    behind, and two runs at a time at worst store a digest twice. Repeated rows and ids get a row each; other columns are
    not returned. Texts are encoded in parts between which no token can lie (byte-level files; the rest
    whole), equal parts of a megabyte once, so memory follows ``BATCH``, ``MEMO`` and the longest text.

    The ``hot_keys`` texts with the most copies are looked up without a shuffle, from a broadcast of at
    most that many digests; every other text has at most ``rows / hot_keys`` copies.
    """
    counter = Counter(path or tokenizer_path())
    spark = docs.sparkSession
    keyed = docs.select("doc_id", C.text_of().alias("text"))
    keyed = C.stage(keyed.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), digest_of("text").alias("digest")))
    groups = C.stage(keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    append_misses(docs, groups, cache, counter)
    known = entries(spark, cache, counter.version)
    hot = groups.where("copies > 1").orderBy(F.col("copies").desc(), "digest").limit(hot_keys).select("digest")
    hot = C.stage(hot.join(known, "digest").select(F.col("digest").alias("_hot"), F.col("n_tokens").alias("_tokens")))
    marked = keyed.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    own = ["doc_id", "n_bytes"]
    near = marked.where("_hot is not null").select(*own, F.col("_tokens").alias("n_tokens"))
    far = marked.where("_hot is null").join(known, "digest", "left").select(*own, "n_tokens")
    return near.unionByName(far)


def report(docs: DataFrame, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``count_tokens`` and whether a text has more than ``limit`` ids; without a folder, a new one in the shared folder."""
    counted = count_tokens(docs, cache or C.shared_folder(docs.sparkSession))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
