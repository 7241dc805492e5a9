"""Content digests, manifests and staged promotion of tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import Checks


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): the same for the same rows in any order and any files.

    A row's MD5 is cut into two halves of 60 bits, which are summed over all
    rows, so the digest is one aggregate without a sort or a gathered column.
    """
    row = F.md5(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    h = df.select(half(1).alias("a"), half(16).alias("b"))
    return h.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*"), F.coalesce(F.sum("a"), F.lit(0)).cast("string"), F.coalesce(F.sum("b"), F.lit(0)).cast("string")), 256).alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files; meant for manifests and small artifacts."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(name: str, tables: dict[str, DataFrame], **fields) -> dict:
    out = {"block": name, **fields, "output_tables": {}}
    for n, df in tables.items():
        r = content_digest(df).first()
        out["output_tables"][n] = {"rows": r["rows"], "sha256": r["digest"], "columns": df.columns}
    return out


def manifest_text(content: dict) -> str:
    return json.dumps(content, indent=2, ensure_ascii=False)


def verify(content: dict, tables: dict[str, DataFrame]) -> Checks:
    """Recomputes the digests of a manifest."""
    checks = Checks()
    for n, known in content["output_tables"].items():
        checks.add(f"{n}_present", n in tables)
        if n in tables:
            r = content_digest(tables[n]).first()
            checks.add(f"{n}_unchanged", (r["rows"], r["digest"]) == (known["rows"], known["sha256"]), r["digest"])
    return checks


def promote(df: DataFrame, path: str, check=None) -> DataFrame:
    """Write beside ``path``, check what was written, and only then put it in place.

    ``check(reread) -> Checks`` decides; if it fails, the old table stays.
    """
    spark = df.sparkSession
    staging, old = f"{path.rstrip('/')}_staging_{uuid.uuid4().hex}", f"{path.rstrip('/')}_old_{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        written = spark.read.parquet(staging)
        if check is not None:
            check(written).require()
    except Exception:
        fs.delete(p(staging), True)
        raise
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)):
        fs.delete(p(staging), True)
        raise OSError(f"{path} could not be set aside; it is unchanged")
    if not fs.rename(p(staging), p(path)):
        if had and not fs.rename(p(old), p(path)):
            raise OSError(f"neither table could be put in place; the old one is {old}, the new one {staging}")
        fs.delete(p(staging), True)
        raise OSError(f"the new table could not be put in place; {path} is unchanged")
    if had:
        fs.delete(p(old), True)
    return spark.read.parquet(path)


def write_manifest(spark: SparkSession, content: dict, path: str) -> str:
    """The manifest's text as one file; returns the text."""
    text = manifest_text(content)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return text


def pass_through(spark: SparkSession, source: str, target: str) -> Checks:
    """Copy a file without reading it as a table; the check compares both files' bytes by digest."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    copied = jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    same = [file_sha256(spark, x) for x in (source, target)] if copied else ["", "-"]
    return Checks().add("copied", bool(copied)).add("bytes_equal", same[0] == same[1], same[0])


def file_sha256(spark: SparkSession, path: str, chunk: int = 1 << 20) -> str:
    """SHA-256 of a file's bytes, read in chunks through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    wrapped = jvm.java.security.DigestInputStream(stream, digest)
    try:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(wrapped, jvm.java.io.OutputStream.nullOutputStream(), chunk, False)
    finally:
        wrapped.close()
    return bytes(b & 0xFF for b in digest.digest()).hex()


#: what a stage declares that it did and did not do, and where it learned
CONTRACT = {"fit_partition": "train", "transform_partitions": ["train", "test"], "test_used_in_fit": False, "target_used_in_fit": False, "rows_dropped": False}


def stage_manifest(name: str, tables: dict[str, DataFrame], flags: dict[str, bool], **contract) -> dict:
    """A manifest with operation flags and the fit/transform contract; flags are booleans, unknown contract fields raise."""
    if bad := [k for k, v in flags.items() if not isinstance(v, bool)]:
        raise ValueError(f"flags that are not true or false: {', '.join(bad)}")
    if unknown := set(contract) - set(CONTRACT):
        raise ValueError(f"unknown contract fields: {', '.join(sorted(unknown))}")
    return manifest(name, tables, operation_flags=dict(flags), contract=CONTRACT | contract)
