"""Archives and made corpora: members of ZIP files, arrays of NPZ files, and documents from templates."""

from __future__ import annotations

import io
import posixpath
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an NPZ file that are read at most.
MOST_NPZ = 32 << 20


def safe_member(name: Column) -> Column:
    """Whether a path stays below its root: relative, without drive, parent steps, back slashes or control characters."""
    return (name != "") & ~name.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\\|[\x00-\x1f]")


def zip_members(files: DataFrame) -> DataFrame:
    """path, member, error, content for the files in archives (path, content); what would leave the root has an error and no content."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            inside = not posixpath.normpath(info.filename.replace("\\", "/")).startswith(("..", "/")) and ":" not in info.filename
                            if not info.is_dir():
                                rows.append((path, info.filename, None if inside else "leaves the root", z.read(info) if inside else None))
                except (zipfile.BadZipFile, OSError, RuntimeError, TypeError):
                    rows = [(path, None, "not an archive", None)]
                yield pd.DataFrame(rows, columns=["path", "member", "error", "content"])

    return files.select("path", "content").mapInPandas(read, "path string, member string, error string, content binary")


def read_arrays(spark: SparkSession, path: str) -> dict:
    """The arrays of one small NPZ file, without pickles."""
    import numpy as np

    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_NPZ).select("content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("not one NPZ file of a permitted size")
    with np.load(io.BytesIO(rows[0].content), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def array_bytes(arrays: dict) -> bytes:
    """Arrays as an NPZ file that is the same for the same arrays."""
    import numpy as np

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in sorted(arrays):
            part = io.BytesIO()
            np.lib.format.write_array(part, np.ascontiguousarray(arrays[name]), allow_pickle=False)
            z.writestr(zipfile.ZipInfo(f"{name}.npy", (1980, 1, 1, 0, 0, 0)), part.getvalue())
    return out.getvalue()


#: Kinds of the pages of a made document, with and without lists of contents.
FULL = ["cover", "legal", "abstract", "acknowledgements", "contents", "contents", "list_of_figures", "list_of_tables", "abbreviations", "preface", "body_start", "other_front", "other_front", "other_front"]
SHORT = ["cover", "abstract", "preface", "body_start", "other_front"]


def made_pages(spark: SparkSession, documents: int, seed: int = 7) -> DataFrame:
    """doc, language, style, page, kind, text of made documents: every fourth is short and has no lists."""
    n = F.col("id")
    docs = spark.range(documents).select(
        F.concat(F.lit("made-"), n.cast("string")).alias("doc"), F.element_at(F.array(*map(F.lit, ("en", "zh", "en", "zh"))), (n % 4 + 1).cast("int")).alias("language"), (n % 3).alias("style"),
        F.posexplode(F.when(n % 4 == 3, F.array(*map(F.lit, SHORT))).otherwise(F.array(*map(F.lit, FULL)))).alias("i", "kind"), (F.lit(seed) + n * 104_729).alias("key"),
    )
    entry = lambda i: F.concat(i.cast("string"), F.lit(" Topic "), F.pmod(F.xxhash64("key", "i", i), F.lit(1000)).cast("string"), F.lit(" ..... "), (i + 10).cast("string"))
    listed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), entry), "\n")
    text = F.when(F.col("kind").isin("contents", "list_of_figures", "list_of_tables"), listed).otherwise(F.concat(F.lit("Text "), F.pmod(F.xxhash64("key", "i"), F.lit(10_000)).cast("string")))
    return docs.select("doc", "language", "style", (F.col("i") + 1).cast("long").alias("page"), "kind", F.concat(F.initcap(F.translate("kind", "_", " ")), F.lit("\n"), text).alias("text"))
