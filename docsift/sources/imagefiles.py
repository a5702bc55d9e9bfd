"""A sink with a file for each row: images in a folder for each degradation, their metadata beside them.

Tasks write files under the names that the rows give, each to a hidden name first and then moved, so that a file is whole or not there and a task that
runs again replaces its own. What a task has written is a part of the metadata; the parts of the attempts that counted are named by the commit, which is
written last. Without it none of a run's rows are listed.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

METADATA_DDL = "original string, degradation string, output string, bytes long"


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def filesystem(path: str):
    """A file system that executors reach, and the path in it: of a URI, or of a plain path on a shared disk."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class ImageFileWriter(DataSourceWriter):
    path: str
    overwrite: bool
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        files, root = filesystem(self.path)
        task = TaskContext.get()
        part, lines, made = f"{self.run}-{task.partitionId() if task else 0}-{uuid.uuid4().hex}.json", [], set()
        for row in iterator:
            if row["content"] is None:
                raise ValueError(f"no content: {row['original']}")
            for name in (row["degradation"], row["file"]):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"not a file name: {name}")
            folder = f"{root}/{row['degradation']}"
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(hidden) as out:
                out.write(bytes(row["content"]))
            files.move(hidden, f"{folder}/{row['file']}")
            lines.append(json.dumps({"original": row["original"], "degradation": row["degradation"], "output": f"{row['degradation']}/{row['file']}", "bytes": len(row["content"])}))
        if lines:
            files.create_dir(f"{root}/_metadata")
            with files.open_output_stream(f"{root}/_metadata/{part}") as out:
                out.write("".join(f"{x}\n" for x in lines).encode())
        return Part(part, len(lines))

    def commit(self, messages) -> None:
        """Names the parts that count, as many as there were tasks. Overwriting, this run's are the only ones."""
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/_metadata")
        before = [x.path for x in self._in(files, f"{root}/_metadata") if x.path.endswith(".commit")]
        hidden = f"{root}/_metadata/.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write(json.dumps([m.name for m in messages if m and m.rows]).encode())
        files.move(hidden, f"{root}/_metadata/{self.run}.commit")
        for path in before if self.overwrite else ():
            files.delete_file(path)

    def abort(self, messages) -> None:
        """Removes the run's parts. Images stay, unlisted, until a run that writes them again."""
        files, root = filesystem(self.path)
        for x in self._in(files, f"{root}/_metadata"):
            if x.base_name.startswith(f"{self.run}-"):
                files.delete_file(x.path)

    @staticmethod
    def _in(files, folder: str):
        from pyarrow import fs

        return files.get_file_info(fs.FileSelector(folder, allow_not_found=True))


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> ImageFileWriter:
        missing = {"original", "degradation", "file", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        return ImageFileWriter(self.options["path"], overwrite)


def write_image_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows (original, degradation, file, content): a file for each at path/degradation/file. A folder and a file name at one degradation are one image."""
    rows.sparkSession.dataSource.register(ImageFiles)
    rows.select("original", "degradation", "file", "content").write.format("image_files").mode(mode).option("path", path).save()


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(original, degradation, output, bytes) of all images that committed runs have written."""
    files, root = filesystem(path)
    commits = [x.path for x in ImageFileWriter._in(files, f"{root}/_metadata") if x.path.endswith(".commit")]
    parts = [name for c in commits for name in json.loads(files.open_input_stream(c).read())]
    if not parts:
        return spark.createDataFrame([], METADATA_DDL)
    return spark.read.schema(METADATA_DDL).json([f"{path}/_metadata/{p}" for p in parts])


def degraded_files(images: DataFrame, extension: str = "jpg") -> DataFrame:
    """rows for write_image_files from degraded images (stem, degradation, content)."""
    return images.select(F.concat("stem", F.lit(f".{extension}")).alias("original"), "degradation", F.concat("stem", F.lit("_"), "degradation", F.lit(f".{extension}")).alias("file"), "content")
