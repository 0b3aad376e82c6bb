"""Image files, one for each distinct image, with records beside them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from veritab.operators.sampling import first_per_key

#: The endings that a name may have already; any other gets the first.
ENDINGS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: counts only, so that the driver's share doesn't grow with the files."""

    files: int
    size: int


class FileWriter(DataSourceWriter):
    """Writes each row's bytes under its name, at first under another one, so that a lost task leaves no half file and its second attempt gives the same; ``_SUCCESS`` holds the counts."""

    def __init__(self, path: str):
        self.path = path

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator) -> Written:
        system, root = self._place()
        system.create_dir(root, recursive=True)
        files = size = 0
        for row in iterator:
            draft = f"{root}/_draft-{uuid.uuid4()}"
            with system.open_output_stream(draft) as out:
                out.write(bytes(row.content))
            system.move(draft, f"{root}/{row.name}")
            files, size = files + 1, size + len(row.content)
        return Written(files, size)

    def commit(self, messages: list) -> None:
        system, root = self._place()
        system.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list) -> None:
        """Files of tasks that ended stay; without ``_SUCCESS`` the folder isn't whole, and another run writes them again."""


class NamedFiles(DataSource):
    """Rows (name, content) as files of a folder, by ``df.write.format("named_files")``; Spark's ``binaryFile`` reads them again."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def file_name(image_id: Column) -> Column:
    """An image's file name. Slashes and percent signs, which would make it another path, are encoded, and a dot or underscore that would hide it from readers."""
    safe = F.replace(F.replace(image_id, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    safe = F.regexp_replace(F.regexp_replace(safe, r"^\.", "%2E"), "^_", "%5F")
    known = F.lit(False)
    for e in ENDINGS:
        known = known | F.endswith(F.lower(safe), F.lit(e))
    return F.when(known, safe).otherwise(F.concat(safe, F.lit(ENDINGS[0])))


def image_records(df: DataFrame, image: str = "image", row: str = "row_no") -> DataFrame:
    """``df`` (image bytes, row, and perhaps image_id, question_id, question, answer, answers) with its image's file name instead of the bytes.

    Rows without an image go. A missing or empty id is ``idx_<row>``, a missing question id the row; ``text`` is the question; without an answer, its answers that aren't blank
    are joined by a comma, or it is empty.
    """
    own = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    number = F.col(row).cast("string")
    image_id = F.concat(F.lit("idx_"), number)
    if "image_id" in df.columns:
        image_id = F.when(F.col("image_id").cast("string") != "", F.col("image_id").cast("string")).otherwise(image_id)
    out = df.where(F.col(image).isNotNull()).withColumns({"image_id": image_id, "question_id": own("question_id", F.col(row)), "text": own("question", F.lit(None).cast("string"))})
    if "answer" not in df.columns:
        kind = df.schema["answers"].dataType if "answers" in df.columns else None
        if isinstance(kind, T.ArrayType):
            said = F.array_join(F.filter(F.transform("answers", lambda a: F.trim(a.cast("string"))), lambda a: a != ""), ", ")
            out = out.withColumn("answer", F.coalesce(said, F.lit("")))
        else:
            out = out.withColumn("answer", F.coalesce(F.col("answers").cast("string"), F.lit("")) if kind else F.lit(""))
    return out.withColumn(image, file_name(F.col("image_id")))


def export_images(df: DataFrame, path: str, image: str = "image", row: str = "row_no") -> None:
    """A file for each distinct image under ``path``/images, with the bytes of its first row, and all records as JSON lines under ``path``/records.

    Files come first: records in place mean that their images are. Ids whose files have one name share the file of the first row.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    bytes_ = df.withColumn("_bytes", F.col(image))
    records = image_records(bytes_, image, row)
    files = first_per_key(records.select(F.col(image).alias("name"), F.col(row), F.col("_bytes").alias("content")), "name", row).select("name", "content")
    files.write.format("named_files").option("path", f"{path}/images").mode("append").save()
    records.drop("_bytes").write.mode("overwrite").json(f"{path}/records")
