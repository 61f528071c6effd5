"""Tables, dictionaries, lines and sequences: readers and writers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import ordered_keywords
from ..functions.vocab import pad
from ..operators.kept import numbered
from ..operators.relations import flatten_groups, negatives

# Greatest lengths of the four sequences of a function.
SEQUENCE_LENGTHS = {"name": 6, "api": 30, "tokens": 50, "desc": 30}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_csv(spark: SparkSession, path: str, missing: Sequence[str] = ()) -> DataFrame:
    """A CSV table with a header, all columns strings. Empty cells are null, and so are those that equal one of `missing`."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, encoding="UTF-8")
    for word in missing:
        df = df.select([F.when(F.col(f"`{c}`") != word, F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def read_csv_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none or it cannot be read."""
    if not exists(spark, path):
        return None
    try:
        return read_csv(spark, path)
    except Exception as e:  # noqa: BLE001  an unreadable table counts as missing, whatever Spark raises
        print(f"{path}: {e}")
        return None


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small text, such as a prompt."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_keywords(spark: SparkSession, path: str, protocol: str) -> DataFrame:
    """A keyword dictionary as (category, keyword, description)."""
    data, protocol = json.loads(read_text(spark, path)), protocol.lower()
    if protocol == "http":
        data = data["keywords"]
        rows = [("status_code", str(k), str(v)) for k, v in data.get("status_code", {}).items()]
        rows += [(c, str(k), None) for c in ("field_name", "content_coding", "method", "syntax") for k in data.get(c, [])]
    elif protocol == "tls":
        rows = [(c, str(k), None) for c, v in data.items() for k in v.get("keywords", [])]
    else:
        raise ValueError(f"unsupported protocol {protocol!r}")
    return spark.createDataFrame(rows, schemas.KEYWORD)


def flat_keywords(table: DataFrame) -> list[str]:
    """Distinct keywords of a dictionary with the descriptions of its codes, by length and text."""
    return ordered_keywords([x for r in table.select("keyword", "description").collect() for x in r if x is not None])  # a dictionary is small


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """{group: {subgroup: [ids]}} as (sr_id, group, subgroup); what has another shape is left out, and of repeated ids the last counts."""
    outer = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("outer"))
    inner = F.transform_values("outer", lambda _, v: F.transform_values(F.coalesce(F.from_json(v, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda _, ids: F.coalesce(F.from_json(ids, "array<string>"), F.array().cast("array<string>"))))
    return flatten_groups(outer.select(inner.alias("groups")))


def sequence_set(names: DataFrame, apis: DataFrame, tokens: DataFrame, descriptions: DataFrame | None = None, lengths: Mapping[str, int] = SEQUENCE_LENGTHS, seed: int = 1) -> DataFrame:
    """The data set of a joint encoder from tables (id, ids) of integer sequences whose ids run from 0.

    Each sequence is cut and padded with zeros to its greatest length, with the length before padding (`name_len`, ...).
    With descriptions each row also has those of a row chosen by a hash of the seed (`bad_desc`). Tables that differ in
    their rows are an error. Joins are by merging: a file of compressed ids says little of the rows that come of it, and
    no side is to pass through the driver. Sequences are cut before and padded after.
    """
    parts = {"name": names, "api": apis, "tokens": tokens} | ({"desc": descriptions} if descriptions is not None else {})
    rows = check_counts(*parts.values())
    out = None
    for name, part in parts.items():
        most = lengths[name]
        one = part.select("id", F.slice("ids", 1, most).alias(name), F.least(F.size("ids"), F.lit(most)).alias(f"{name}_len"))
        out = one if out is None else out.join(one.hint("merge"), "id")
    if descriptions is not None:
        paired = negatives(one.select("id", F.struct("desc", "desc_len").alias("_desc")), "id", "_desc", rows, seed)
        out = out.join(paired.select("id", F.col("negative.desc").alias("bad_desc"), F.col("negative.desc_len").alias("bad_desc_len")).hint("merge"), "id")
    most = {**lengths, "bad_desc": lengths.get("desc")}
    return out.select(*[pad(F.col(c), most[c]).alias(c) if c in parts or c == "bad_desc" else c for c in out.columns])


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(id, line): one row for each line, numbered from 0 in file order."""
    lines = spark.read.option("encoding", encoding).csv(path, sep="\u0001", quote="", header=False, schema="line string") if encoding.upper() not in ("UTF-8", "UTF8") else spark.read.text(path).withColumnRenamed("value", "line")
    return numbered(lines, "id").select("id", "line")


def with_ordinal(df: DataFrame, name: str = "sr_id") -> DataFrame:
    """df with each row's position in the source, from 0, as its first column."""
    return numbered(df, name).select(name, *[F.col(f"`{c}`") for c in df.columns if c != name])


def ragged_slices(sequences: DataFrame, start: int, count: int, rows: int) -> DataFrame:
    """Rows (id from 0 to rows - 1) from start on, wrapped round at the end; count -1 takes every row once."""
    if count < 0:
        count = rows
    wanted = sequences.sparkSession.range(count).select(F.col("id").alias("at"), F.pmod(F.col("id") + start, F.lit(rows)).alias("id"))
    return sequences.join(wanted, "id")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of all part files below path."""
    return spark.read.schema(schemas.VECTOR).parquet(path)


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """Functions from JSON lines, with all fields of their schema; those that a line lacks are null."""
    return spark.read.schema(schemas.FUNCTION).json(path)


def read_sequences(spark: SparkSession, path: str, lengths: Mapping[str, int] = SEQUENCE_LENGTHS, seed: int = 1) -> DataFrame:
    """sequence_set() of a Parquet table (id, name, api, tokens, desc); without descriptions where the table has none.

    A column that lacks some rows' sequences (null) differs in its rows from the others, which is an error.
    """
    rows = spark.read.schema(schemas.SEQUENCE).parquet(path)
    sides = [rows.select("id", F.col(c).alias("ids")).filter("ids IS NOT NULL") for c in ("name", "api", "tokens", "desc")]
    described = not sides[3].isEmpty()
    return sequence_set(*sides[:3], sides[3] if described else None, lengths, seed)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, id) from JSON text that is one object of words and ids."""
    return spark.createDataFrame([(k, int(v)) for k, v in json.loads(read_text(spark, path)).items()], schemas.VOCABULARY)


def check_counts(*tables: DataFrame) -> int:
    """The number of rows that all tables have."""
    counts = {t.count() for t in tables}
    if len(counts) != 1:
        raise ValueError(f"tables differ in their rows: {sorted(counts)}")
    return counts.pop()


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object for each row, nulls included, in UTF-8."""
    df.write.option("ignoreNullFields", False).json(path)


def readable(df: DataFrame, columns: Mapping[str, str], text: str, ident: Column) -> DataFrame:
    """(id, sr, keywords_found): comma-joined columns as lists under their titles."""
    from ..functions.text import cell_to_list

    return df.select(ident.alias("id"), F.col(f"`{text}`").alias("sr"), F.struct(*[cell_to_list(F.col(f"`{c}`")).alias(title) for c, title in columns.items()]).alias("keywords_found"))


def reordered(columns: Sequence[str], fresh: Sequence[str], after: str = "SR Text") -> list[str]:
    """Columns with the fresh ones right behind one of them, each once."""
    old = [c for c in columns if c not in fresh]
    at = old.index(after) + 1 if after in old else len(old)
    return [*old[:at], *dict.fromkeys(fresh), *old[at:]]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and doubled quotes; an empty table gives the header alone."""
    df.write.csv(path, header=True, escape='"', emptyValue="")


def write_vectors(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Compressed part files of at most so many vectors; any number of rows will do."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


# Names of a workflow's output tables.
OUTPUTS = ("sr", "functions", "functions_filtered", "dual_filter", "sr_constraints", "pre_verify", "final_verify")


def write_outputs(tables: Mapping[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each table of a workflow."""
    for name, df in tables.items():
        if name not in OUTPUTS:
            raise ValueError(f"unknown output {name!r}")
        write_jsonl(df, f"{path}/{name}")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, "F.Observation"]:
    """df that counts its rows while it is used, for progress reports."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
