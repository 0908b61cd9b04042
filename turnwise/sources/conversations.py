"""Readers: transcripts from Parquet or tab-separated text, word vectors, token lists as text."""

from __future__ import annotations

import gzip
import io
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

REQUIRED = ("participant", "content")


def read_parquet(spark: SparkSession, path: str, conditions: int = 25) -> DataFrame:
    """Turns of a (conv_id, turn, role, text) table; the condition is conv_id modulo `conditions`."""
    name = F.concat(F.lit("dyad"), F.col("conv_id").cast("string"), F.lit("-cond"), (F.col("conv_id") % conditions).cast("string"), F.lit(".txt"))
    return spark.read.parquet(path).select(name.alias("source_file"), "turn", F.col("role").alias("participant"), F.col("text").alias("content"))


#: What counts as missing besides the empty string (fixed values).
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: A field: in quotes, which are doubled inside and may hold tabs and line ends, or plain.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^\t\n]*+|$)|[^\t\n"][^\t\n]*+|)'
#: Files whose headers are read for the names of further columns.
HEADERS = 16


def read_tsv(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.txt", missing: Sequence[str] = MISSING, required: Sequence[str] = REQUIRED, more: Sequence[str] | None = None) -> DataFrame:
    """Turns of tab-separated files with a header, one conversation a file, in the order of lines.

    A field that begins with a quote is quoted; empty fields and those in `missing` are null, and
    blank lines are passed over.  Files without the required columns are left out.  `more` names
    further columns, which are strings; without it they are those of the first few files.  Files of
    one name in several folders keep as much of their path as tells them apart.  Files are read
    whole, since only so do lines keep their order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = lambda at: spark.read.option("pathGlobFilter", pattern).text(at, wholetext=True)
    raw = read(paths)
    files = sorted(raw.inputFiles())  # the names that were listed to plan the read
    depth = 1
    while len({tuple(f.split("/")[-depth:]) for f in files}) < len(files):
        depth += 1
    name = F.array_join(F.slice(F.split(F.input_file_name(), "/"), -depth, depth), "/") if depth > 1 else F.element_at(F.split(F.input_file_name(), "/"), -1)
    text = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
    records = F.filter(F.regexp_extract_all(text, F.lit(rf"{_FIELD}(?:\t{_FIELD})*+"), F.lit(0)), lambda r: r != "")
    fields = lambda r: F.transform(F.regexp_extract_all(F.concat(F.lit("\t"), r), F.lit(rf"\t({_FIELD})"), F.lit(1)), _unquoted)
    lines = raw.select(name.alias("source_file"), records.alias("_lines")).withColumn("_head", fields(F.col("_lines")[0]))
    for c in required:
        lines = lines.where(F.array_contains("_head", c))
    rows = lines.select("source_file", "_head", F.posexplode(F.slice("_lines", 2, 1 << 30)).alias("_at", "_line"))
    rows = rows.select("source_file", "_head", "_at", fields(F.col("_line")).alias("_values"))

    def column(c: str) -> Column:
        got = F.when(F.array_position("_head", c) > 0, F.try_element_at("_values", F.array_position("_head", c).cast("int")))
        return F.when((got != "") & ~got.isin(*missing), got) if missing else F.nullif(got, F.lit(""))

    if more is None:
        some = read(files[:HEADERS]).select(fields(F.split(text, "\n")[0]).alias("h")).collect() if files else []
        more = sorted({n for r in some for n in r["h"]})
    more = [n for n in more if n and n not in (*REQUIRED, "turn", "source_file")]
    kept = [c for c in REQUIRED if c in required]
    return rows.select("source_file", F.col("_at").cast("long").alias("turn"), *[column(n).alias(n) for n in (*kept, *more)])


def _unquoted(field: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(field, r'^"((?:[^"]|"")*+)"?', "$1"), '""', '"')
    return F.when(field.startswith('"'), inner).otherwise(field)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file with a word and its numbers on each line; a first line of two
    numbers is passed over."""
    parts = F.split(F.trim("value"), " ")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return lines.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, 1 << 30), lambda x: x.cast("float")).alias("vector"))


def read_binary_vectors(spark: SparkSession, path: str, batch: int = 4096) -> DataFrame:
    """(word, vector) of binary files of word vectors, packed by gzip or not: a line of two numbers,
    then each word, a space and its 32-bit floats.  Words have no fixed length, so a file is one
    task's, and at most 2 GB on disk."""

    def run(batches):
        for files in batches:
            for content in files.column(0):
                raw = io.BytesIO(content.as_buffer())
                raw = gzip.GzipFile(fileobj=raw) if raw.read(2) == b"\x1f\x8b" and not raw.seek(0) else raw
                raw.seek(0)
                source = io.BufferedReader(raw, 1 << 20)
                many, dims = map(int, source.readline().split())
                words, vectors = [], []
                for _ in range(many):
                    word = bytearray()
                    while (c := source.read(1)) != b" ":
                        if not c:
                            raise ValueError("a file of word vectors ends early")
                        word += c
                    vector = source.read(4 * dims)
                    if len(vector) < 4 * dims:
                        raise ValueError("a file of word vectors ends early")
                    words.append(word.lstrip(b"\n").decode("utf-8", "replace"))
                    vectors.append(np.frombuffer(vector, "<f4"))
                    if len(words) == batch:
                        yield _vectors(words, vectors)
                        words, vectors = [], []
                if words:
                    yield _vectors(words, vectors)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, vector array<float>")


def _vectors(words: list[str], vectors: list) -> pa.RecordBatch:
    flat, dims = np.concatenate(vectors), len(vectors[0])
    ends = np.arange(len(vectors) + 1, dtype=np.int32) * dims
    return pa.RecordBatch.from_arrays([pa.array(words), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()))], names=["word", "vector"])


def read_surrogates(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """read_tsv() of surrogates that were written before; raises if there are none."""
    try:
        made = read_tsv(spark, paths, **options)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"there is no folder of surrogates at {paths}") from error
    if made.isEmpty():
        raise ValueError(f"there are no surrogates in {paths}")
    return made


def list_of_words(text: Column) -> Column:
    """A list that was written as text (['a', "b's"]) as an array; empty if it is none."""
    found = F.regexp_extract_all(text, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    inner = F.transform(found, lambda w: F.regexp_replace(F.substring(w, F.lit(2), F.length(w) - 2), r"\\(.)", "$1"))
    return F.when(F.trim(text).startswith("[") & F.trim(text).endswith("]"), inner).otherwise(F.array().cast("array<string>"))
