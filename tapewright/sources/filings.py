"""Readers of filing documents, the choice of the newest file, and dated writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECENT = "struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,reportDate:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>>"
_ADDRESS = "struct<street1:string,street2:string,city:string,stateOrCountry:string,zipCode:string>"
SUBMISSIONS = f"cik string, name string, sic string, sicDescription string, addresses struct<mailing:{_ADDRESS},business:{_ADDRESS}>, phone string, exchanges array<string>, tickers array<string>, filings struct<recent:{_RECENT}>"
FACTS = "cik bigint, entityName string, facts map<string,map<string,struct<units:map<string,array<struct<end:string,val:double,fy:bigint,fp:string,form:string,filed:string>>>>>>"
CIK_MAP = "map<string,struct<ticker:string,cik_str:string>>"
INDEX = "directory struct<item:array<struct<name:string,type:string,size:string,last_modified:string>>>"


def whole_files(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias(value), F.col("_metadata.file_path").alias("file"))


def parse_submissions(texts: DataFrame, value: str = "value") -> DataFrame:
    rows = texts.withColumn("s", F.from_json(value, SUBMISSIONS)).filter("s.cik is not null")
    return rows.select(*[c for c in texts.columns if c != value], F.col("s.tickers")[0].alias("ticker"), "s.*")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return parse_submissions(whole_files(spark, path))


def parse_company_facts(texts: DataFrame, value: str = "value") -> DataFrame:
    """(cik, taxonomy, concept, unit, pos, end_date, val, form): a row per reported value, in their order."""
    rows = texts.select(F.from_json(value, FACTS).alias("f")).select("f.cik", F.explode("f.facts").alias("taxonomy", "concepts"))
    rows = rows.select("cik", "taxonomy", F.explode("concepts").alias("concept", "c")).select("cik", "taxonomy", "concept", F.posexplode("c.units").alias("unit_no", "unit", "values"))
    rows = rows.select("cik", "taxonomy", "concept", "unit", "unit_no", F.posexplode("values").alias("place", "v"))
    pos = (F.col("unit_no").cast("long") * 1_000_000_000 + F.col("place")).alias("pos")
    return rows.select("cik", "taxonomy", "concept", "unit", pos, F.col("v.end").try_cast("date").alias("end_date"), "v.val", "v.form", "v.fy", "v.fp", F.col("v.filed").try_cast("date").alias("filed"))


def read_company_facts(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """A company in each file, as they are downloaded; by_line: in each line of files that hold any number of them."""
    return parse_company_facts(spark.read.text(path) if by_line else whole_files(spark, path))


def parse_cik_map(texts: DataFrame, value: str = "value") -> DataFrame:
    """ticker in upper case and cik with ten digits; entries without either are left out."""
    rows = texts.select(F.explode(F.map_values(F.from_json(value, CIK_MAP))).alias("e")).filter("e.ticker is not null and e.cik_str is not null")
    return rows.select(F.upper("e.ticker").alias("ticker"), F.lpad("e.cik_str", 10, "0").alias("cik"))


def read_cik_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_cik_map(whole_files(spark, path))


def read_form4(spark: SparkSession, path: str) -> DataFrame:
    """(accession_no, xml) of files named by their accession number."""
    return whole_files(spark, path, "xml").select(F.regexp_extract("file", r"([^/]+)\.xml$", 1).alias("accession_no"), "xml")


def parse_filing_index(texts: DataFrame, key: str = "accession_no", value: str = "value") -> DataFrame:
    rows = texts.select(key, F.from_json(value, INDEX).alias("i")).select(key, F.posexplode("i.directory.item").alias("pos", "d"))
    return rows.select(key, "pos", "d.*").filter("coalesce(name, '') <> ''")


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Indexes in files: <accession>/index.json, or <accession>.json; the number is the folder's or the file's name."""
    name = F.coalesce(F.nullif(F.regexp_extract("file", r"([^/]+)/index\.json$", 1), F.lit("")), F.regexp_extract("file", r"([^/]+)\.json$", 1))
    texts = whole_files(spark, path).withColumn("accession_no", name)
    return parse_filing_index(texts)


def latest_dump(rows: DataFrame, keys: list[str], as_of: str, written: str = "written", kind: str = "data_type", fresh_types: tuple = ("submissions", "forms")) -> DataFrame:
    """The newest of each key, if it may still be used: types that must be fresh are of the day as_of; others always."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), written).alias("d")).select(*keys, "d.*")
    return newest.filter(~F.col(kind).isin(*fresh_types) | (F.to_date(written) == F.lit(as_of).cast("date")))


def write_partitioned(rows: DataFrame, path: str, as_of: str, by: str = "ticker", kind: str = "parquet", files: int = 1) -> None:
    """Appends rows under by=.../as_of=...; up to so many files, and tasks, for a key: more than one where a key may have very many rows."""
    dated = rows.withColumn("as_of", F.lit(as_of))
    deal = [by] if files == 1 else [by, F.pmod(F.xxhash64(*rows.columns), F.lit(files))]
    dated.repartition(*deal).write.mode("append").partitionBy(by, "as_of").format(kind).save(path)
