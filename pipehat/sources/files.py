"""Message files in and out: whole files, files of many messages, and batches."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENVELOPE = ("FHS", "BHS", "BTS", "FTS")


def read_messages(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """(message_id, source_path, message): a message for each file, or with ``split`` one for each MSH line in it.

    The id is the file name, with ``split`` followed by ``_00001`` and so on.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("message_id"), F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("message"))
    return split_messages(files) if split else files


def read_large(spark: SparkSession, path: str, line_end: str = "\r") -> DataFrame:
    """(message_id, source_path, message): the messages of large batch files, read in splits by as many tasks as the files have blocks.

    Lines end in ``line_end`` (one of \\r, \\n and \\r\\n, the same in all files). A record begins at every line that starts with MSH; envelope lines
    are left out. Ids are the file name and a number that is unique, and ascending within a file, but not without gaps.
    """
    rows = spark.read.option("lineSep", f"{line_end}MSH").text(path)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("source_path"), "value", F.monotonically_increasing_id().alias("n"))
    # a record that the separator cut begins with its field delimiter; the first of a file begins with MSH or an envelope line
    whole = F.when(F.startswith("value", F.lit("MSH")), F.col("value")).when(~F.col("value").rlike("^[A-Za-z0-9]"), F.concat(F.lit("MSH"), F.col("value")))
    lines = F.filter(F.split(whole, line_end, -1), lambda s: ~F.substring(s, 1, 3).isin(*ENVELOPE))
    text = F.regexp_replace(F.array_join(lines, line_end), "[\r\n]+$", "")
    return rows.where(whole.isNotNull()).select(F.concat_ws("_", "file", F.col("n").cast("string")).alias("message_id"), "source_path", text.alias("message"))


def write_named(rows: DataFrame, path: str) -> list[str]:
    """A file in the folder ``path`` for each row of ``rows`` (name, text), called by its name: for few files, as the driver gives them their names."""
    spark = rows.sparkSession
    parts = f"{path.rstrip('/')}/.parts"
    rows.select("name", F.col("text").alias("value")).write.partitionBy("name").option("lineSep", "\n").mode("overwrite").text(parts)
    jvm = spark.sparkContext._jvm
    folder, names = jvm.org.apache.hadoop.fs.Path(parts), []
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for own in store.listStatus(folder):
        if not own.isDirectory():
            continue
        name = urllib.parse.unquote(own.getPath().getName().partition("=")[2])
        for part in store.listStatus(own.getPath()):
            if part.getPath().getName().startswith("part-"):
                target = jvm.org.apache.hadoop.fs.Path(path, name)
                store.delete(target, False)
                store.rename(part.getPath(), target)
                names.append(name)
    store.delete(folder, True)
    return sorted(names)


def _named(column: str, added: str) -> Column:
    """A file name with ``added`` before its extension."""
    return F.regexp_replace(column, r"^(.*?)(\.[^.]*)?$", f"$1{added}$2")


def write_split(files: DataFrame, path: str, prefix: str) -> list[str]:
    """The messages of ``files`` (message_id, message) as ``<prefix>_00001.txt`` and so on, in order of the file and the place in it."""
    rows = split_messages(files)
    place = F.row_number().over(Window.orderBy("message_id"))  # one task numbers them: for few messages
    named = F.concat(F.lit(f"{prefix}_"), F.lpad(place.cast("string"), 5, "0"), F.lit(".txt"))
    return write_named(rows.select(named.alias("name"), F.regexp_replace("message", "[\r\n]+$", "").alias("text")), path)


def _starts(name: str) -> str:
    """Where a line of that name begins, not within a line; nothing is taken from the text."""
    return f"(?<=[\r\n])(?={name})"


def _split(files: DataFrame, name: str, column: str) -> DataFrame:
    rest = [c for c in files.columns if c not in ("message_id", column)]
    parts = F.filter(F.split(column, _starts(name), -1), lambda m: F.startswith(m, F.lit(name)))
    rows = files.select("message_id", *rest, F.posexplode(parts).alias("__at", column))
    number = F.concat(F.col("message_id"), F.lit("_"), F.lpad((F.col("__at") + 1).cast("string"), 5, "0"))
    return rows.select(number.alias("message_id"), *rest, column)


def split_messages(files: DataFrame, column: str = "message") -> DataFrame:
    """A row for each message of a file: from one line that starts with MSH to the next. What comes before the first is left out."""
    return _split(files, "MSH", column)


def split_batches(files: DataFrame, column: str = "message") -> DataFrame:
    """A row for each batch file in a file: from one line that starts with FHS to the next."""
    return _split(files, "FHS", column)


def without_envelope(text: Column) -> Column:
    """``text`` without its FHS, BHS, BTS and FTS lines; lines are joined by carriage returns."""
    lines = F.split(text, "\r\n|\r|\n", -1)
    return F.array_join(F.filter(lines, lambda s: ~F.substring(s, 1, 3).isin(*ENVELOPE)), "\r")


def debatch(files: DataFrame, column: str = "message") -> DataFrame:
    """The messages of batches, without the envelope; ids as in ``split_messages``."""
    return split_messages(files.withColumn(column, without_envelope(F.col(column))), column)


def write_messages(messages: DataFrame, path: str, column: str = "message") -> None:
    """Text files with one message for each row, one after the other, so that ``read_messages(split=True)`` reads them again."""
    ended = F.regexp_replace(column, "[\r\n]+$", "")
    messages.select(ended.alias("value")).write.option("lineSep", "\r").text(path)


def observation_text(messages: DataFrame, id_column: str = "message_id") -> DataFrame:
    """(id, line_number, text): the observation values of each message, repetitions joined by line breaks, for reading."""
    from ..operators.frames import located_values

    rows = located_values(messages, "OBX-5", id_column)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repetition", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy(id_column, "line_number").agg(text.alias("text"))


def write_each(messages: DataFrame, path: str, column: str = "message") -> None:
    """A folder ``message_id=<id>`` for each message, with one text file: for few messages, as each is a file of its own."""
    messages.select("message_id", F.col(column).alias("value")).write.partitionBy("message_id").option("lineSep", "\r").text(path)


def write_observation_text(messages: DataFrame, path: str, id_column: str = "message_id") -> None:
    """The ``observation_text`` of each message, in line order, as text files."""
    rows = observation_text(messages, id_column)
    rows.repartition(id_column).sortWithinPartitions(id_column, "line_number").select(F.col("text").alias("value")).write.text(path)


def deidentify_files(spark: SparkSession, path: str, rules_path: str, out: str) -> DataFrame:
    """Clean the messages of ``path`` by the rules in a text file (a rule a line; empty lines and # lines are skipped).

    The messages go to ``out``; the report of what was done comes back.
    """
    from ..operators.deidentify import deidentify, redaction_report

    cleaned = deidentify(read_messages(spark, path, split=True), _rules(spark, rules_path))
    write_messages(cleaned.where("message is not null"), out)
    return redaction_report(cleaned)


def _rules(spark: SparkSession, path: str) -> list[str]:
    lines = [r.value.strip() for r in spark.read.text(path).collect()]
    return [r for r in lines if r and not r.startswith("#")]


def deidentify_each(spark: SparkSession, path: str, rules_path: str, out: str) -> DataFrame:
    """``<name>_deidentified<extension>`` in ``out`` for each file of ``path``, by the rules in a text file; the report comes back."""
    from ..operators.deidentify import deidentify, redaction_report

    whole = read_messages(spark, path)
    cleaned = deidentify(split_messages(whole.withColumn("file", F.col("message_id"))), _rules(spark, rules_path))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("message_id", "message"))), lambda x: F.regexp_replace(x["message"], "[\r\n]+$", ""))
    joined = cleaned.where("message is not null").groupBy("file").agg(F.array_join(texts, "\r").alias("text"))
    write_named(joined.select(_named("file", "_deidentified").alias("name"), "text"), out)
    return redaction_report(cleaned)


def write_clean(spark: SparkSession, path: str, out: str) -> list[str]:
    """``<name>_clean<extension>`` in ``out`` for each file of ``path``: the observation values of its messages, in order, for reading."""
    rows = split_messages(read_messages(spark, path).withColumn("file", F.col("message_id")))
    text = observation_text(rows.withColumn("message_id", F.struct("file", "message_id")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("message_id", "line_number", "text"))), lambda x: x["text"])
    found = text.groupBy("message_id.file").agg(F.array_join(lines, "\n").alias("text"))
    return write_named(found.select(_named("file", "_clean").alias("name"), "text"), out)
