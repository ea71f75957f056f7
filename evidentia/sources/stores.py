"""Sources and sinks: pictures, sound, request lines, captured pages, history, cache."""

from __future__ import annotations

import io
import wave
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.shipping import ship

# Suffixes of sound and of moving pictures that can be heard.
AUDIO = ("wav", "mp3", "flac", "ogg", "opus", "m4a", "aac", "wma")
VIDEO = ("mp4", "mkv", "webm", "mov", "avi", "m4v", "mpg", "mpeg", "wmv", "flv")
MAX_MEDIA_BYTES = 512 << 20
CACHE_SECONDS = 7 * 86_400


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of a folder: path, height, width, channels, data (BGR bytes); one that can't be decoded has a null width."""
    found = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    bad = F.col("width") <= 0
    return found.select(F.col("origin").alias("path"), *(F.when(~bad, F.col(c)).alias(c) for c in ("height", "width")), F.col("nChannels").alias("channels"), "data")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with reason, null for those that can be heard: path, length, reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("reason", F.when(~suffix.isin(*AUDIO, *VIDEO), "unsupported_type").when(F.col("length") > MAX_MEDIA_BYTES, "too_large").when(F.col("length") == 0, "empty"))


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 samples from -1 to 1 (the mean of the channels) and the rate."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def clips(files: DataFrame, content: str = "content") -> DataFrame:
    """Append samples (array of float), rate and error to WAV files; samples are null where error isn't."""
    ship(files.sparkSession)

    @F.pandas_udf("samples array<float>, rate int, error string")
    def decode(c: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in c:
            try:
                x, rate = decode_wav(raw)
                rows.append((x, rate, None))
            except (wave.Error, EOFError, KeyError, TypeError, ValueError) as e:
                rows.append((None, None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["samples", "rate", "error"])

    return files.withColumn("__clip", decode(content)).select(*files.columns, "__clip.*")


def request_lines(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Requests, one JSON object a line: request_id, operation, input (JSON text), and corrupt for lines that are none."""
    schema = "requestId string, operation string, input string, noStore boolean, maxCalls int, corrupt string"
    reader = (spark.readStream if stream else spark.read).schema(schema).option("columnNameOfCorruptRecord", "corrupt")
    return reader.json(path).withColumnRenamed("requestId", "request_id")


def history(entries: DataFrame, most: int, query: str = "") -> DataFrame:
    """The newest entries (id, created_at, text) that contain query, whatever its case."""
    found = entries.where(F.contains(F.lower("text"), F.lit(query.lower()))) if query else entries
    return found.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def cached(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """keys with the newest cached dump of less than seven days, null for a miss. cache: key, ts, dump."""
    fresh = cache.where((now.cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double") <= CACHE_SECONDS) & F.col("dump").isNotNull())
    newest = fresh.groupBy("key").agg(F.max(F.struct("ts", "dump"))["dump"].alias("dump"))
    return keys.join(newest, "key", "left")


def write_once(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table at path doesn't have: content-addressed, so that writing again changes nothing."""
    spark = df.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


class _Nodes(HTMLParser):
    """Visible text nodes and controls of a page in document order."""

    SKIP, CONTROL = {"script", "style", "noscript", "template", "head"}, {"a", "button", "input", "select", "textarea"}
    EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.texts: list[tuple[str, str]] = []
        self.controls: list[tuple[str, str]] = []
        self.rasters: list[str] = []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in self.CONTROL:
            self.controls.append((tag, at.get("aria-label") or at.get("name") or ""))
        if tag == "img" and at.get("src"):
            self.rasters.append(at["src"])
        if tag not in self.EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.SKIP.intersection(self.open):
            self.texts.append((text, self.open[-1] if self.open else ""))


def captured(pages: DataFrame, html: str = "html") -> DataFrame:
    """Append texts (text, parent), controls (tag, name) and rasters of each page; a null page has none."""
    ship(pages.sparkSession)

    @F.pandas_udf("texts array<struct<text: string, parent: string>>, controls array<struct<tag: string, name: string>>, rasters array<string>")
    def parse(c: pd.Series) -> pd.DataFrame:
        rows = []
        for page in c:
            p = _Nodes()
            p.feed(page or "")
            p.close()
            rows.append(([{"text": t, "parent": q} for t, q in p.texts], [{"tag": t, "name": n} for t, n in p.controls], p.rasters))
        return pd.DataFrame(rows, columns=["texts", "controls", "rasters"])

    return pages.withColumn("__nodes", parse(html)).select(*pages.columns, "__nodes.*")


def fit_budget(assets: DataFrame, group: str, order: str, size: str, each: int, total: int, most: int) -> DataFrame:
    """Assets of each group in turn that fit: none beyond each bytes, total bytes in all, most in number; what is refused spends nothing.

    A fold over the group's ordered array: group, order, spent.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(size).cast("long").alias("n"))))
    empty = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<struct<k: long, spent: long>>").alias("kept"))

    def take(s, x):
        ok = (x["n"] <= each) & (s["spent"] + x["n"] <= total) & (F.size(s["kept"]) < most)
        now = s["spent"] + x["n"]
        return F.when(ok, F.struct(now.alias("spent"), F.concat(s["kept"], F.array(F.struct(x["k"].cast("long").alias("k"), now.alias("spent")))).alias("kept"))).otherwise(s)

    return assets.groupBy(group).agg(F.aggregate(items, empty, take)["kept"].alias("kept")).select(group, F.explode("kept").alias("a")).select(group, F.col("a.k").alias(order), "a.spent")


