"""Queries on filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import filings as O
from tapewright.plans import sqltext as S
from tapewright.plans.market import _rounded, _with
from tapewright.sources import filings as R
from tapewright.sources import views
from tapewright.streaming.streams import new_folder

AS_OF = "2001-08-01"


def _as_files(texts: DataFrame) -> str:
    """Writes (file, value) as a text file for each, as they lie in a cache of downloads, and returns the pattern of their paths."""
    path = new_folder(texts.sparkSession, "files")
    texts.repartition("file").write.partitionBy("file").text(path)
    return f"{path}/*/*.txt"


def _cik_map(spark, d) -> DataFrame:
    """Ticker maps written and parsed again, each file an object of some companies: two of three tickers have a number."""
    rows = views.filings(spark, d).select("ticker").distinct().filter("cast(substr(ticker, 2) as int) % 3 <> 0")
    entry = F.struct(F.lower("ticker").alias("ticker"), F.substr("ticker", F.lit(2)).alias("cik_str"))
    some = F.pmod(F.xxhash64("ticker"), F.lit(8)).alias("file")
    whole = rows.groupBy(some).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("ticker", entry.alias("e"))))).alias("value"))
    return R.read_cik_map(spark, _as_files(whole))


def _submissions(spark, d) -> DataFrame:
    """The filings of a ticker as parallel arrays; report dates lack the last one."""
    item = F.struct("accession_no", "filing_date", "form")
    rows = views.filings(spark, d).groupBy("ticker").agg(F.sort_array(F.collect_list(item)).alias("f"))
    text = lambda c: F.transform("f", lambda x: x[c].cast("string"))
    recent = F.struct(text("accession_no").alias("accessionNumber"), text("filing_date").alias("filingDate"), text("form").alias("form"), F.slice(text("filing_date"), F.lit(1), F.size("f") - 1).alias("reportDate"))
    number = F.substr("ticker", F.lit(2))
    address = F.struct(F.struct(F.concat(F.lit("Street "), number).alias("street1"), F.lit("Springfield").alias("city")).alias("mailing"))
    body = F.struct(
        F.lpad(number, 10, "0").alias("cik"), F.concat(F.lit("Company "), "ticker").alias("name"), F.array("ticker").alias("tickers"), F.array(F.lit("NYSE"), F.lit("CBOE")).alias("exchanges"),
        F.concat(F.lit("7"), number).alias("sic"), F.lit("Services").alias("sicDescription"), F.concat(F.lit("555-"), number).alias("phone"), address.alias("addresses"), F.struct(recent.alias("recent")).alias("filings"),
    )
    return R.read_submissions(spark, _as_files(rows.select(F.col("ticker").alias("file"), F.to_json(body).alias("value"))))


def _facts_text(spark, d) -> DataFrame:
    """Facts as nested JSON and back: a line for each company, as there are too many companies for a file each."""
    one = F.struct(F.col("pos").alias("o"), F.struct(F.col("end_date").cast("string").alias("end"), "val", "form").alias("v"))
    by_unit = views.facts(spark, d).groupBy("cik", "taxonomy", "concept", "unit").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["v"]).alias("v"), F.min("pos").alias("first"))
    units = by_unit.groupBy("cik", "taxonomy", "concept").agg(F.sort_array(F.collect_list(F.struct("first", "unit", "v"))).alias("u"))
    units = units.withColumn("units", F.map_from_entries(F.transform("u", lambda x: F.struct(x["unit"], x["v"]))))
    concepts = units.groupBy("cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("c"))
    whole = concepts.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "c"))).alias("facts"))
    path = new_folder(spark, "facts")
    whole.select(F.to_json(F.struct("cik", "facts")).alias("value")).write.text(path)
    return R.read_company_facts(spark, path, by_line=True)


def _form4(spark, d) -> DataFrame:
    """Transactions of a filing as one XML document, and parsed again."""
    value = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(f"</value></{tag}>"))
    code = F.concat(F.lit("<transactionCoding><transactionCode>"), "transaction_code", F.lit("</transactionCode></transactionCoding>"))
    amounts = F.concat(F.lit("<transactionAmounts>"), value("transactionShares", "shares"), value("transactionPricePerShare", "price_per_share"), F.lit("</transactionAmounts>"))
    date = value("transactionDate", "transaction_date")
    after = F.concat(F.lit("<postTransactionAmounts>"), value("sharesOwnedFollowingTransaction", F.col("shares") * 2), F.lit("</postTransactionAmounts>"))
    plain = F.concat(F.lit("<nonDerivativeTransaction>"), value("securityTitle", F.lit("Common Stock")), date, code, amounts, after, F.lit("</nonDerivativeTransaction>"))
    derived = F.concat(F.lit("<derivativeTransaction>"), value("securityTitle", F.lit("Option")), value("conversionOrExercisePrice", F.col("shares") + 0.5), date, code, amounts, value("expirationDate", F.date_add("transaction_date", 365)), F.lit("</derivativeTransaction>"))
    rows = views.insider(spark, d).withColumns({"plain": F.when(~F.col("is_derivative"), plain), "derived": F.when(F.col("is_derivative"), derived)})
    docs = rows.groupBy("accession_no").agg(F.array_join(F.collect_list("plain"), "").alias("p"), F.array_join(F.collect_list("derived"), "").alias("q"), F.min("ticker").alias("t"), F.min("owner_name").alias("o"))
    case = F.col("accession_no") % 6
    relationship = (
        F.when(case == 0, "<isDirector>true</isDirector>")
        .when(case == 1, "<isOfficer>1</isOfficer><officerTitle>CFO</officerTitle>")
        .when(case == 2, "<isTenPercentOwner>1</isTenPercentOwner>")
        .when(case == 3, "<isDirector>1</isDirector><isOfficer>true</isOfficer>")
        .when(case == 4, "<isOther>1</isOther>")
        .otherwise("<isDirector>0</isDirector>")
    )
    xml = F.concat(
        F.lit("<ownershipDocument><issuer><issuerCik>"), F.substr("t", F.lit(2)), F.lit("</issuerCik><issuerName>Issuer "), "t", F.lit("</issuerName><issuerTradingSymbol>"), "t",
        F.lit("</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>"), "o", F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>"), relationship,
        F.lit("</reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"), "p", F.lit("</nonDerivativeTable><derivativeTable>"), "q", F.lit("</derivativeTable></ownershipDocument>"),
    )
    return O.parse_form4(docs.select("accession_no", xml.alias("xml")))


_POSITION = "CASE accession_no % 6 WHEN 0 THEN 'Director' WHEN 1 THEN 'Officer (CFO)' WHEN 2 THEN '10% Owner' WHEN 3 THEN 'Director, Officer' WHEN 4 THEN 'Other' ELSE 'N/A' END"


def _documents(spark, d) -> DataFrame:
    """Filing indexes made of line items, written as JSON and read again."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "XML").when(F.col("l_linenumber") % 3 == 1, "10-K").otherwise("GRAPHIC")
    end = F.when(F.col("l_partkey") % 4 == 0, ".xml").when(F.col("l_partkey") % 4 == 1, ".htm").when(F.col("l_partkey") % 4 == 2, ".jpg").otherwise("-index.html")
    name = F.concat(F.when(F.col("l_suppkey") % 5 == 0, "form4_").otherwise("doc_"), F.col("l_partkey").cast("string"), end)
    item = F.struct("l_linenumber", F.struct(name.alias("name"), kind.alias("type"), F.col("l_quantity").cast("int").cast("string").alias("size"), F.col("l_shipdate").cast("date").cast("string").alias("last_modified")).alias("d"))
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("accession_no")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["d"]).alias("item"))
    return R.parse_filing_index(rows.select("accession_no", F.to_json(F.struct(F.struct("item").alias("directory"))).alias("value")))


_DOCS = """docs AS (SELECT l_orderkey AS accession_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat(CASE WHEN l_suppkey % 5 = 0 THEN 'form4_' ELSE 'doc_' END, l_partkey), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), l_shipdate) - 1 AS pos,
 concat(CASE WHEN l_suppkey % 5 = 0 THEN 'form4_' ELSE 'doc_' END, l_partkey, CASE l_partkey % 4 WHEN 0 THEN '.xml' WHEN 1 THEN '.htm' WHEN 2 THEN '.jpg' ELSE '-index.html' END) AS name,
 CASE l_linenumber % 3 WHEN 0 THEN 'XML' WHEN 1 THEN '10-K' ELSE 'GRAPHIC' END AS type, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS size, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS last_modified FROM lineitem)"""
_CIKS = "ciks AS (SELECT DISTINCT ticker, lpad(substr(ticker, 2), 10, '0') AS cik FROM filings WHERE CAST(substr(ticker, 2) AS INTEGER) % 3 <> 0)"


def _pick(where: str, high: str) -> str:
    return _with(f"SELECT accession_no, arg_min(name, CASE WHEN {high} THEN -1000 - pos ELSE pos END) AS name FROM docs WHERE {where} GROUP BY 1", _DOCS)


def f1(spark, d):
    return O.explode_filings(_submissions(spark, d)).select("ticker", "accession_no", "filing_date", "form", "report_date", "url")


def _view(spark, d) -> DataFrame:
    """Transactions, derivatives with an exercise price, and filings with an address and a document."""
    tx = views.insider(spark, d).withColumn("exercise_price", F.when(F.col("is_derivative"), F.col("shares") + 0.5))
    own = views.filings(spark, d).withColumns({"url": O.filing_url(F.substr("ticker", F.lit(2)), F.col("accession_no")), "primary_document": F.concat(F.lit("doc"), F.col("accession_no"), F.lit(".xml"))}).drop("ticker")
    return O.insider_view(tx, own, views.table(spark, d, "lineitem").count())


def f6(spark, d):
    return _rounded(_view(spark, d), "value", "price").select("ticker", "accession_no", "owner_name", "transaction_date", "shares", "price", "value", "filing_date", "form", "url", "primary_document")


def t6(spark, d):
    return O.recent_filings(_view(spark, d)).select("ticker", "accession_no", "owner_name", "transaction_code", "shares")


def a15_period(spark, d):
    """Filings of customers, some of them without a transaction."""
    own = views.table(spark, d, "orders").selectExpr("concat('P', o_custkey % 200) AS ticker", "o_orderkey AS accession_no", "CAST(o_orderdate AS DATE) AS filing_date")
    tx = views.insider(spark, d).filter("accession_no % 5 <> 0")
    return O.insider_summary(tx, _codes(spark), own, AS_OF, 2000).withColumns({c: F.round(c, 2) for c in ("buy_value", "sell_value", "net_value")})


def s7(spark, d):
    kind = F.when(F.col("accession_no") % 2 == 0, "facts").otherwise("forms").alias("data_type")
    rows = views.filings(spark, d).select("ticker", kind, F.struct("filing_date", "accession_no").alias("written_key"), F.col("filing_date").alias("written"), "accession_no")
    return R.latest_dump(rows.drop("written_key").withColumn("written", F.timestamp_seconds(F.unix_date("written") * 86400 + F.col("accession_no") % 86400)), ["ticker", "data_type"], AS_OF).select("ticker", "data_type", F.to_date("written").alias("day"))


def _codes(spark):
    return O.transaction_codes(spark)


FILINGS: dict[str, tuple] = {
    "s3_company_facts": (lambda s, d: _facts_text(s, d).select("cik", "concept", "unit", "end_date", "val", "form"), _with("SELECT cik, concept, unit, end_date, val, form FROM facts", S.FACTS)),
    "s4_cik_map": (_cik_map, _with("SELECT * FROM ciks", S.FILINGS, _CIKS)),
    "s6_filing_index": (lambda s, d: _documents(s, d).select("accession_no", F.col("pos").cast("long").alias("pos"), "name", "type"), _with("SELECT accession_no, pos, name, type FROM docs", _DOCS)),
    "s7_latest_dump": (
        s7,
        _with(
            f"SELECT ticker, data_type, day FROM (SELECT ticker, CASE WHEN accession_no % 2 = 0 THEN 'facts' ELSE 'forms' END AS data_type, max(filing_date) AS day FROM filings GROUP BY 1, 2) WHERE data_type = 'facts' OR day = DATE '{AS_OF}'",
            S.FILINGS,
        ),
    ),
    "j1_with_cik": (lambda s, d: O.with_cik(views.filings(s, d), _cik_map(s, d)).select("ticker", "accession_no", "cik"), _with("SELECT ticker, accession_no, cik FROM filings LEFT JOIN ciks USING (ticker)", S.FILINGS, _CIKS)),
    "j2_filing_cik": (
        lambda s, d: O.filing_cik(views.filings(s, d).withColumn("accession_no", F.concat(F.lpad(F.col("accession_no").cast("string"), 10, "0"), F.lit("-01-000001"))), _cik_map(s, d)).select("accession_no", "cik"),
        _with("SELECT lpad(CAST(accession_no AS VARCHAR), 10, '0') || '-01-000001' AS accession_no, ltrim(coalesce(cik, lpad(CAST(accession_no AS VARCHAR), 10, '0')), '0') AS cik FROM filings LEFT JOIN ciks USING (ticker)", S.FILINGS, _CIKS),
    ),
    "j3_filings_for": (
        lambda s, d: O.filings_for(views.table(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey") % 700).alias("ticker")), views.filings(s, d), "Form 4", AS_OF),
        _with(
            f"SELECT t.ticker, coalesce(n, 0) AS n_filings, CAST(latest AS VARCHAR) AS latest FROM (SELECT DISTINCT 'C' || (c_custkey % 700) AS ticker FROM customer) t LEFT JOIN (SELECT ticker, count(*) AS n, max(filing_date) AS latest FROM filings WHERE form = '4' AND filing_date >= DATE '{AS_OF}' - 90 GROUP BY 1) f USING (ticker)",
            S.FILINGS,
        ),
    ),
    "j4_insider_view": (
        f6,
        _with(
            "SELECT i.ticker, accession_no, owner_name, transaction_date, shares, round(CASE WHEN is_derivative THEN shares + 0.5 ELSE price_per_share END, 6) AS price, CASE WHEN NOT is_derivative THEN round(shares * price_per_share, 6) END AS value, filing_date, form, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(substr(f.ticker, 2), '0') || '/' || accession_no || '/' AS url, 'doc' || accession_no || '.xml' AS primary_document FROM insider i JOIN filings f USING (accession_no)",
            S.INSIDER,
            S.FILINGS,
        ),
    ),
    "j5_metric_concepts": (
        lambda s, d: O.with_metric(views.facts(s, d)).select("cik", "metric", "concept", "pos", "val"),
        _with("SELECT cik, CASE concept WHEN 'NetIncomeLoss' THEN 'net_income' WHEN 'Assets' THEN 'assets' WHEN 'Liabilities' THEN 'liabilities' WHEN 'StockholdersEquity' THEN 'equity' ELSE 'revenue' END AS metric, concept, pos, val FROM facts", S.FACTS),
    ),
    "j6_transaction_codes": (
        lambda s, d: O.with_codes(views.insider(s, d), _codes(s)).select("ticker", "accession_no", "transaction_code", "description", "is_buy", "is_sell", "shares"),
        _with("SELECT ticker, accession_no, transaction_code, description, is_buy, is_sell, shares FROM coded", S.INSIDER, S.CODES),
    ),
    "f1_explode_filings": (
        f1,
        _with(
            "SELECT ticker, CAST(accession_no AS VARCHAR) AS accession_no, filing_date, form, filing_date AS report_date, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(substr(ticker, 2), '0') || '/' || accession_no || '/' AS url FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY accession_no, filing_date, form) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM filings) WHERE k < n",
            S.FILINGS,
        ),
    ),
    "f2_filings_by_form": (lambda s, d: O.filings_by_form(views.filings(s, d), "10-K", AS_OF), _with(f"SELECT * FROM filings WHERE form = '10-K' AND filing_date >= DATE '{AS_OF}' - 730", S.FILINGS)),
    "f3_filing_url": (
        lambda s, d: views.filings(s, d).select("accession_no", O.filing_url(F.lpad(F.substr("ticker", F.lit(2)), 10, "0"), F.concat(F.lit("00-"), F.col("accession_no").cast("string"))).alias("url")),
        _with("SELECT accession_no, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(substr(ticker, 2), '0') || '/00' || accession_no || '/' AS url FROM filings", S.FILINGS),
    ),
    "f4_parse_form4": (
        lambda s, d: _form4(s, d),
        _with(
            f"""SELECT accession_no, substr(t, 2) AS issuer_cik, 'Issuer ' || t AS issuer_name, t AS ticker, o AS owner_name, {_POSITION} AS position, CASE WHEN is_derivative THEN 'Option' ELSE 'Common Stock' END AS security,
 transaction_date, transaction_code, shares, price_per_share, is_derivative, CASE WHEN NOT is_derivative THEN shares * 2 END AS shares_after, CASE WHEN is_derivative THEN shares + 0.5 END AS exercise_price,
 CASE WHEN is_derivative THEN transaction_date + 365 END AS expiration_date FROM insider JOIN (SELECT accession_no, min(ticker) AS t, min(owner_name) AS o FROM insider GROUP BY 1) USING (accession_no)""",
            S.INSIDER,
        ),
    ),
    "f5_owner_position": (
        lambda s, d: _form4(s, d).select("accession_no", "position").distinct(),
        _with(f"SELECT DISTINCT accession_no, {_POSITION} AS position FROM insider", S.INSIDER),
    ),
    "f7_latest_fact": (lambda s, d: O.latest_fact(views.facts(s, d)), _with("SELECT cik, taxonomy, concept, unit, end_date, val, pos, form FROM latest", S.FACTS, S.LATEST)),
    "f8_company_info": (
        lambda s, d: O.company_info(_submissions(s, d)).withColumns({"street": F.col("address.street1"), "city": F.col("address.city"), "exchanges": F.array_join("exchanges", ",")}).drop("address"),
        _with("SELECT DISTINCT lpad(substr(ticker, 2), 10, '0') AS cik, 'Company ' || ticker AS name, '7' || substr(ticker, 2) AS sic, 'Services' AS sic_description, '555-' || substr(ticker, 2) AS phone, 'NYSE,CBOE' AS exchanges, 'Street ' || substr(ticker, 2) AS street, 'Springfield' AS city FROM filings", S.FILINGS),
    ),
    "f9_pick_primary_document": (
        lambda s, d: O.pick_primary_document(_documents(s, d)),
        _pick("regexp_matches(name, '\\.(xml|htm|html)$') AND NOT name LIKE '%-index.html'", "name LIKE 'form4%' OR type IN ('XML', '10-K')"),
    ),
    "f10_pick_form4_xml": (lambda s, d: O.pick_form4_xml(_documents(s, d)), _pick("name LIKE '%.xml'", "name LIKE 'form4%' OR type = 'XML'")),
    "f11_html_document_link": (
        lambda s, d: O.html_document_link(views.table(s, d, "pages").select("page_id", F.concat("html", F.lit("<table><tr><td><a href='/x/doc"), "page_id", F.lit(".htm'>a</a></td></tr></table>"), F.when(F.col("page_id") % 3 == 0, '<a href="/a/Primary_doc.xml">').otherwise("")).alias("html"))).select("page_id", "link"),
        """WITH h AS (SELECT page_id, concat(html, '<table><tr><td><a href=''/x/doc', page_id, '.htm''>a</a></td></tr></table>', CASE WHEN page_id % 3 = 0 THEN '<a href="/a/Primary_doc.xml">' ELSE '' END) AS html FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(html, 'href=["''][^"'']*(primary_doc\\.xml)["'']', 1, 'i'), ''), nullif(regexp_extract(regexp_extract(html, '<table.*?>(.*?)</table>', 1, 'is'), 'href=["''](?:[^"'']*/)?([^"''/]+\\.(?:htm|xml))["'']', 1, 'i'), '')) AS link FROM h""",
    ),
    "f12_filing_documents": (
        lambda s, d: _documents(s, d).withColumn("pos", F.col("pos").cast("long")),
        _with("SELECT accession_no, pos, name, type, size, last_modified FROM docs", _DOCS),
    ),
    "f13_form_descriptions": (
        lambda s, d: views.filings(s, d).join(F.broadcast(O.form_descriptions(s)), "form", "left").groupBy("form", "description").agg(F.count(F.lit(1)).alias("n")),
        _with("SELECT form, CASE form WHEN '4' THEN 'Statement of changes in beneficial ownership (insider transactions)' WHEN '10-K' THEN 'Annual report' WHEN '10-Q' THEN 'Quarterly report' WHEN '8-K' THEN 'Current report' ELSE 'Definitive proxy statement' END AS description, count(*) AS n FROM filings GROUP BY 1", S.FILINGS),
    ),
    "f14_ratios": (
        lambda s, d: _rounded(O.ratios(O.financial_summary(views.facts(s, d))), "debt_to_equity", "net_margin"),
        _with(
            "SELECT cik, round(max(CASE WHEN concept = 'Liabilities' THEN val END) / max(CASE WHEN concept = 'StockholdersEquity' THEN val END), 6) AS debt_to_equity, round(max(CASE WHEN concept = 'NetIncomeLoss' THEN val END) / max(CASE WHEN concept LIKE 'Revenue%' THEN val END), 6) AS net_margin FROM latest GROUP BY 1",
            S.FACTS,
            S.LATEST,
        ),
    ),
    "a15_insider_summary": (
        lambda s, d: O.insider_summary(views.insider(s, d), _codes(s)).withColumns({c: F.round(c, 2) for c in ("buy_value", "sell_value", "net_value")}),
        _with(
            """SELECT ticker, count(DISTINCT accession_no) AS n_filings, count(*) AS n_transactions, count(*) FILTER (WHERE is_buy AND NOT is_derivative) AS n_buys, count(*) FILTER (WHERE is_sell AND NOT is_derivative) AS n_sells,
 round(coalesce(sum(shares * price_per_share) FILTER (WHERE is_buy AND NOT is_derivative), 0), 2) AS buy_value, round(coalesce(sum(shares * price_per_share) FILTER (WHERE is_sell AND NOT is_derivative), 0), 2) AS sell_value,
 count(DISTINCT owner_name) AS n_owners, string_agg(DISTINCT owner_name, ',' ORDER BY owner_name) AS owners, min(transaction_date) AS first_date, max(transaction_date) AS last_date,
 round(coalesce(sum(shares * price_per_share) FILTER (WHERE is_buy AND NOT is_derivative), 0) - coalesce(sum(shares * price_per_share) FILTER (WHERE is_sell AND NOT is_derivative), 0), 2) AS net_value FROM coded GROUP BY 1""",
            S.INSIDER,
            S.CODES,
        ),
    ),
    "a15_insider_summary_period": (
        a15_period,
        _with(
            """SELECT ticker, n AS n_filings, count(*) AS n_transactions, count(*) FILTER (WHERE is_buy AND NOT is_derivative) AS n_buys, count(*) FILTER (WHERE is_sell AND NOT is_derivative) AS n_sells,
 round(coalesce(sum(shares * price_per_share) FILTER (WHERE is_buy AND NOT is_derivative), 0), 2) AS buy_value, round(coalesce(sum(shares * price_per_share) FILTER (WHERE is_sell AND NOT is_derivative), 0), 2) AS sell_value,
 count(DISTINCT owner_name) AS n_owners, string_agg(DISTINCT owner_name, ',' ORDER BY owner_name) AS owners, min(transaction_date) AS first_date, max(transaction_date) AS last_date,
 round(coalesce(sum(shares * price_per_share) FILTER (WHERE is_buy AND NOT is_derivative), 0) - coalesce(sum(shares * price_per_share) FILTER (WHERE is_sell AND NOT is_derivative), 0), 2) AS net_value
 FROM mine JOIN (SELECT ticker, count(DISTINCT accession_no) AS n FROM period GROUP BY 1) USING (ticker) GROUP BY ticker, n""",
            S.INSIDER,
            S.CODES,
            f"period AS (SELECT 'P' || (o_custkey % 200) AS ticker, o_orderkey AS accession_no FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 2000)",
            "mine AS (SELECT c.* EXCLUDE (ticker), p.ticker FROM coded c JOIN period p USING (accession_no) WHERE accession_no % 5 <> 0)",
        ),
    ),
    "a16_financial_summary": (
        lambda s, d: O.financial_summary(views.facts(s, d)).select("cik", "revenue", "net_income", "assets", "liabilities", "equity", F.col("period_end").cast("string").alias("period_end"), "form"),
        _with(
            """SELECT cik, max(val) FILTER (WHERE concept LIKE 'Revenue%') AS revenue, max(val) FILTER (WHERE concept = 'NetIncomeLoss') AS net_income, max(val) FILTER (WHERE concept = 'Assets') AS assets, max(val) FILTER (WHERE concept = 'Liabilities') AS liabilities,
 max(val) FILTER (WHERE concept = 'StockholdersEquity') AS equity, CAST(max(end_date) FILTER (WHERE concept LIKE 'Revenue%' OR concept = 'NetIncomeLoss') AS VARCHAR) AS period_end,
 arg_max(form, epoch_us(end_date) * 2 + CASE WHEN concept LIKE 'Revenue%' THEN 1 ELSE 0 END) FILTER (WHERE concept LIKE 'Revenue%' OR concept = 'NetIncomeLoss') AS form FROM latest GROUP BY 1""",
            S.FACTS,
            S.LATEST,
        ),
    ),
    "a17_transactions_by_type": (lambda s, d: O.transactions_by_type(views.insider(s, d), _codes(s)), _with("SELECT ticker, transaction_code, description, count(*) AS n FROM coded GROUP BY 1, 2, 3", S.INSIDER, S.CODES)),
    "a17_top_traders_by_value": (
        lambda s, d: O.top_traders_by_value(views.insider(s, d), _codes(s)),
        _with(
            "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, action ORDER BY value DESC, owner_name) AS INTEGER) AS rank FROM (SELECT ticker, CASE WHEN is_buy THEN 'buy' ELSE 'sell' END AS action, owner_name, round(sum(shares * price_per_share), 2) AS value FROM coded WHERE NOT is_derivative AND (is_buy OR is_sell) GROUP BY 1, 2, 3)) WHERE rank <= 5",
            S.INSIDER,
            S.CODES,
        ),
    ),
    "t6_recent_filings": (
        t6,
        _with(
            "SELECT ticker, accession_no, owner_name, transaction_code, shares FROM (SELECT i.*, dense_rank() OVER (PARTITION BY i.ticker ORDER BY f.filing_date DESC, accession_no DESC) AS rk FROM insider i JOIN (SELECT accession_no, filing_date FROM filings) f USING (accession_no)) WHERE rk <= 10",
            S.INSIDER,
            S.FILINGS,
        ),
    ),
}
