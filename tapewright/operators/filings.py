"""Company filings: indexes, insider transactions, reported facts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Forms and their meaning, transaction codes, and the concepts of the summary.
FORMS = {
    "4": "Statement of changes in beneficial ownership (insider transactions)",
    "3": "Initial statement of beneficial ownership",
    "5": "Annual statement of beneficial ownership",
    "8-K": "Current report",
    "10-K": "Annual report",
    "10-Q": "Quarterly report",
    "13F": "Institutional investment manager holdings report",
    "SC 13G": "Beneficial ownership report",
    "SC 13D": "Beneficial ownership report (active)",
    "DEF 14A": "Definitive proxy statement",
}
DAYS_BACK = {"10-K": 730, "10-Q": 365, "8-K": 90, "4": 90}
CODES = {
    "P": "Purchase", "S": "Sale", "A": "Award", "D": "Disposition (Gift/Other)", "F": "Tax Withholding", "I": "Discretionary Transaction", "M": "Option Exercise",
    "C": "Conversion", "W": "Warrant Exercise", "G": "Gift", "J": "Other Acquisition/Disposition", "U": "Tender of Shares", "X": "Option Expiration", "Z": "Trust Transaction",
}
BUY_CODES = ("P", "A", "M", "C", "W", "G", "J", "I")
SELL_CODES = ("S", "D", "F", "X", "U", "Z")
METRICS = {
    "revenue": "RevenueFromContractWithCustomerExcludingAssessedTax", "net_income": "NetIncomeLoss", "eps": "EarningsPerShareBasic", "assets": "Assets", "liabilities": "Liabilities",
    "equity": "StockholdersEquity", "operating_cash_flow": "NetCashProvidedByUsedInOperatingActivities", "investing_cash_flow": "NetCashProvidedByUsedInInvestingActivities", "financing_cash_flow": "NetCashProvidedByUsedInFinancingActivities",
}


def form_descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMS.items()), "form string, description string")


def transaction_codes(spark: SparkSession, buys: tuple = BUY_CODES, sells: tuple = SELL_CODES) -> DataFrame:
    rows = [(c, d, c in buys, c in sells) for c, d in CODES.items()]
    return spark.createDataFrame(rows, "transaction_code string, description string, is_buy boolean, is_sell boolean")


def normalized_form(form: Column) -> Column:
    return F.regexp_replace(form, "^Form ", "")


def filings_by_form(filings: DataFrame, form: str | None, as_of: str, days_back: int | None = None) -> DataFrame:
    """Filings of a form (all for None; a prefix "Form " doesn't matter) of the last days up to as_of."""
    name = form.removeprefix("Form ") if form else None
    days = days_back if days_back is not None else DAYS_BACK.get(name, 90)
    rows = filings.filter(F.col("filing_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return rows.filter(F.col("form") == name) if name else rows


def filing_url(cik: Column, accession: Column, document: Column | None = None) -> Column:
    """Address in the archive: the number without leading zeros, the accession without dashes."""
    base = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(cik.cast("string"), F.lit("0")), F.lit("/"), F.replace(accession.cast("string"), F.lit("-"), F.lit("")))
    return F.concat(base, F.lit("/"), document) if document is not None else F.concat(base, F.lit("/"))


def explode_filings(submissions: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Parallel arrays of a company to rows: as many as the shortest of the four core arrays, documents padded with nulls."""
    recent = "filings.recent"
    core = ["accessionNumber", "filingDate", "form", "reportDate"]
    n = F.least(*[F.coalesce(F.array_size(f"{recent}.{c}"), F.lit(0)) for c in core])
    optional = lambda c: F.coalesce(F.col(f"{recent}.{c}"), F.array().cast("array<string>"))
    zipped = F.arrays_zip(*[F.col(f"{recent}.{c}").alias(c) for c in core], optional("primaryDocument").alias("primaryDocument"), optional("primaryDocDescription").alias("primaryDocDescription"))
    rows = submissions.select(ticker, "cik", n.alias("n"), F.posexplode(zipped).alias("pos", "f")).filter("pos < n")
    return rows.select(
        ticker,
        F.col("f.accessionNumber").alias("accession_no"),
        F.col("f.filingDate").try_cast("date").alias("filing_date"),
        F.col("f.form").alias("form"),
        F.col("f.reportDate").try_cast("date").alias("report_date"),
        filing_url(F.col("cik"), F.col("f.accessionNumber")).alias("url"),
        F.col("f.primaryDocument").alias("primary_document"),
        F.col("f.primaryDocDescription").alias("primary_document_description"),
    )


def company_info(submissions: DataFrame) -> DataFrame:
    return submissions.select("cik", "name", "sic", F.col("sicDescription").alias("sic_description"), F.col("addresses.mailing").alias("address"), "phone", "exchanges")


def with_cik(rows: DataFrame, cik_map: DataFrame) -> DataFrame:
    """Adds cik by ticker. The map grows with the number of companies only; Spark broadcasts it while it is small."""
    return rows.join(cik_map.select("ticker", "cik"), "ticker", "left")


def filing_cik(rows: DataFrame, cik_map: DataFrame) -> DataFrame:
    """cik of a filing: the ticker's, else the first ten digits of the accession, without leading zeros."""
    digits = F.substring(F.replace(F.col("accession_no").cast("string"), F.lit("-"), F.lit("")), 1, 10)
    found = F.coalesce("cik", F.when(digits.rlike("^[0-9]{10}$"), digits))
    return with_cik(rows, cik_map).withColumn("cik", F.ltrim(found, F.lit("0")))


def filings_for(tickers: DataFrame, filings: DataFrame, form: str | None, as_of: str, days_back: int | None = None) -> DataFrame:
    """Number of filings of every ticker asked for, those without any too, and the latest."""
    found = filings_by_form(filings, form, as_of, days_back).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_filings"), F.max("filing_date").cast("string").alias("latest"))
    return tickers.select("ticker").distinct().join(found, "ticker", "left").withColumn("n_filings", F.coalesce("n_filings", F.lit(0)))


def with_codes(tx: DataFrame, codes: DataFrame) -> DataFrame:
    """Describes and classes transaction codes; unknown ones are neither bought nor sold."""
    rows = tx.join(F.broadcast(codes), "transaction_code", "left")  # a row for each code
    return rows.withColumns({"description": F.coalesce("description", F.lit("Unknown")), "is_buy": F.coalesce("is_buy", F.lit(False)), "is_sell": F.coalesce("is_sell", F.lit(False))})


#: Transactions that a task joins with their filings, where their number is known.
JOINED_ROWS = 500_000


def insider_view(tx: DataFrame, filings: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Transactions with their filing's date, form, address and document, as far as the tables have them. Derivatives have no value, and their exercise price as price.

    With about how many transactions there are, tasks grow in number with them, not in size: more than run at once are dealt out here, as shuffles of Spark have a fixed number."""
    derivative = F.coalesce("is_derivative", F.lit(False))
    exercise = F.col("exercise_price") if "exercise_price" in tx.columns else F.lit(None).cast("double")
    shown = {"price": F.when(derivative, exercise).otherwise(F.col("price_per_share")), "value": F.when(~derivative, F.coalesce(F.col("shares") * F.col("price_per_share"), F.lit(0.0)))}
    own = [c for c in ("filing_date", "form", "url", "primary_document") if c in filings.columns]
    rows, own = tx.withColumns(shown), filings.select("accession_no", *own)
    tasks = -(-(n_rows or 0) // JOINED_ROWS)
    if tasks > tx.sparkSession.sparkContext.defaultParallelism:
        rows, own = rows.repartition(tasks, "accession_no"), own.repartition(tasks, "accession_no").hint("merge")
    return rows.join(own, "accession_no")


def recent_filings(view: DataFrame, limit: int = 10) -> DataFrame:
    """Transactions of each ticker's latest filings that have any.

    Filings are dealt to a few parts by their number. The latest dates of limit parts are those of as many filings, so none before the least of them is
    wanted, and only what is left is ranked: a task holds a date for each ticker and part, not its filings. A ticker with fewer parts keeps all its rows."""
    n = max(limit, 1)
    part = F.pmod(F.xxhash64("accession_no"), F.lit(8 * n)).alias("part")
    latest = view.groupBy("ticker", part).agg(F.max("filing_date").alias("latest"))
    since = latest.groupBy("ticker").agg(F.try_element_at(F.sort_array(F.collect_list("latest"), False), F.lit(n)).alias("since"))
    near = view.join(F.broadcast(since), "ticker", "left").filter("since is null or filing_date >= since")  # a row for each ticker
    rank = F.dense_rank().over(Window.partitionBy("ticker").orderBy(F.col("filing_date").desc(), F.col("accession_no").desc()))
    return near.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*view.columns)


def insider_summary(tx: DataFrame, codes: DataFrame, filings: DataFrame | None = None, as_of: str | None = None, days_back: int = 90) -> DataFrame:
    """Per ticker: transactions with a date, filings, buys and sells with their values (no derivatives), owners, first and last date.

    With filings (ticker, accession_no, filing_date) and as_of only those of the last days_back days count, a transaction's ticker is its filing's, and
    n_filings are all filings of the period, those without a transaction too."""
    if filings is not None:
        period = filings.filter(F.col("filing_date") >= F.date_sub(F.lit(as_of).cast("date"), days_back)).select("ticker", "accession_no")
        tx = tx.drop("ticker").join(period, "accession_no")
    rows = with_codes(tx, codes).filter("transaction_date is not null")
    value = F.when(F.col("is_derivative"), 0.0).otherwise(F.coalesce(F.col("shares") * F.col("price_per_share"), F.lit(0.0)))
    money = lambda flag: F.sum(F.when(F.col(flag), value).otherwise(0.0))
    # first by owner and filing, which leaves one distinct count: rows aren't multiplied
    per = rows.groupBy("ticker", "accession_no", "owner_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_buy") & ~F.col("is_derivative")).alias("buys"),
        F.count_if(F.col("is_sell") & ~F.col("is_derivative")).alias("sells"),
        money("is_buy").alias("bought"),
        money("is_sell").alias("sold"),
        F.min("transaction_date").alias("first"),
        F.max("transaction_date").alias("last"),
    )
    out = per.groupBy("ticker").agg(
        F.countDistinct("accession_no").alias("n_filings"),
        F.sum("n").alias("n_transactions"),
        F.sum("buys").alias("n_buys"),
        F.sum("sells").alias("n_sells"),
        F.sum("bought").alias("buy_value"),
        F.sum("sold").alias("sell_value"),
        F.sort_array(F.collect_set("owner_name")).alias("names"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    )
    out = out.withColumns({"n_owners": F.size("names").cast("long"), "owners": F.array_join("names", ","), "net_value": F.col("buy_value") - F.col("sell_value")}).drop("names")
    if filings is None:
        return out
    return out.drop("n_filings").join(period.groupBy("ticker").agg(F.countDistinct("accession_no").alias("n_filings")), "ticker")


def transactions_by_type(tx: DataFrame, codes: DataFrame) -> DataFrame:
    return with_codes(tx, codes).groupBy("ticker", "transaction_code", "description").agg(F.count(F.lit(1)).alias("n"))


def top_traders_by_value(tx: DataFrame, codes: DataFrame, n: int = 5) -> DataFrame:
    """The owners who bought, and who sold, for the most money at each ticker."""
    rows = with_codes(tx, codes).filter("not is_derivative and (is_buy or is_sell)")
    action = F.when(F.col("is_buy"), "buy").otherwise("sell").alias("action")
    sums = rows.groupBy("ticker", action, "owner_name").agg(F.round(F.sum(F.col("shares") * F.col("price_per_share")), 2).alias("value"))
    rank = F.row_number().over(Window.partitionBy("ticker", "action").orderBy(F.col("value").desc(), "owner_name"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= n)


def latest_fact(facts: DataFrame) -> DataFrame:
    """The row with the latest end of each (cik, taxonomy, concept): in USD, else shares, else the first unit; the first of equals."""
    first = facts.groupBy("cik", "taxonomy", "concept").agg(F.min_by("unit", "pos").alias("first_unit"))
    rank = F.when(F.col("unit") == "USD", 0).when(F.col("unit") == "shares", 1).when(F.col("unit") == F.col("first_unit"), 2).otherwise(3)
    order = F.struct(rank.alias("rank"), F.date_diff(F.lit("9999-12-31").cast("date"), F.col("end_date")).alias("age"), "pos")
    rows = facts.join(first, ["cik", "taxonomy", "concept"]).filter("end_date is not null and val is not null")
    best = rows.groupBy("cik", "taxonomy", "concept").agg(F.min_by(F.struct("unit", "end_date", "val", "pos", "form"), order).alias("f"))
    return best.select("cik", "taxonomy", "concept", "f.*")


def with_metric(facts: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """Facts of the metrics' concepts, with the metric's name; others are left out."""
    names = facts.sparkSession.createDataFrame([(k, "us-gaap", v) for k, v in metrics.items()], "metric string, taxonomy string, concept string")
    return facts.join(F.broadcast(names), ["taxonomy", "concept"])  # a row for each metric


def financial_summary(facts: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """A row per company: the latest value of each metric, and end and form of the later of revenue and net income."""
    latest = with_metric(latest_fact(facts), metrics)
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m)
    income = F.col("metric").isin("revenue", "net_income")
    order = F.when(income, F.struct("end_date", (F.col("metric") == "revenue").alias("r")))
    return latest.groupBy("cik").agg(*[value(m) for m in metrics], F.max(F.when(income, F.col("end_date"))).alias("period_end"), F.max_by("form", order).alias("form"))


def ratios(summary: DataFrame) -> DataFrame:
    return summary.select("cik", F.try_divide("liabilities", "equity").alias("debt_to_equity"), F.try_divide("net_income", "revenue").alias("net_margin"))


FORM4 = (
    "issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, "
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string,isTenPercentOwner:string,isOther:string>>>, "
    "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<securityTitle:struct<value:string>,transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,"
    "transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>,"
    "postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:string>>>>>, "
    "derivativeTable struct<derivativeTransaction:array<struct<securityTitle:struct<value:string>,conversionOrExercisePrice:struct<value:string>,transactionDate:struct<value:string>,"
    "transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>>,"
    "exerciseDate:struct<value:string>,expirationDate:struct<value:string>>>>"
)


def plain_number(text: Column) -> Column:
    """Digits with at most one point, else 0."""
    return F.coalesce(F.when(text.rlike(r"^(\d+\.?\d*|\.\d+)$"), text.try_cast("double")), F.lit(0.0))


def owner_position(relationship: Column) -> Column:
    flag = lambda c: F.trim(F.coalesce(relationship[c], F.lit("0"))).isin("1", "true")
    title = F.nullif(F.trim(relationship["officerTitle"]), F.lit(""))
    parts = F.concat_ws(
        ", ",
        F.when(flag("isDirector"), "Director"),
        F.when(flag("isOfficer"), F.coalesce(F.concat(F.lit("Officer ("), title, F.lit(")")), F.lit("Officer"))),
        F.when(flag("isTenPercentOwner"), "10% Owner"),
        F.when(flag("isOther"), "Other"),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("N/A"))


def parse_form4(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Transactions of ownership documents (accession_no, xml): derivative ones have an exercise price; a malformed document has none.

    A document is parsed once: both kinds of transactions are brought to one shape before they become rows."""
    parsed = documents.select("accession_no", F.from_xml(F.col(xml), FORM4, {"mode": "PERMISSIVE", "rowTag": "ownershipDocument"}).alias("d"))
    text = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("N/A"))
    none = F.lit(None).cast("string")

    def raw(transactions: str, derivative: bool) -> Column:
        def item(t: Column) -> Column:
            amounts = t["transactionAmounts"]
            return F.struct(
                t["securityTitle"]["value"].alias("security"),
                t["transactionDate"]["value"].alias("transaction_date"),
                t["transactionCoding"]["transactionCode"].alias("transaction_code"),
                amounts["transactionShares"]["value"].alias("shares"),
                amounts["transactionPricePerShare"]["value"].alias("price_per_share"),
                F.lit(derivative).alias("is_derivative"),
                (none if derivative else t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"]).alias("shares_after"),
                (t["conversionOrExercisePrice"]["value"] if derivative else none).alias("exercise_price"),
                (t["expirationDate"]["value"] if derivative else none).alias("expiration_date"),
            )

        return F.coalesce(F.transform(F.col(transactions), item), F.array())

    owner = F.col("d.reportingOwner")[0]
    both = F.concat(raw("d.nonDerivativeTable.nonDerivativeTransaction", False), raw("d.derivativeTable.derivativeTransaction", True))
    return parsed.select("accession_no", F.col("d.issuer").alias("issuer"), owner.alias("owner"), F.explode(both).alias("t")).select(
        "accession_no",
        text(F.col("issuer.issuerCik")).alias("issuer_cik"),
        text(F.col("issuer.issuerName")).alias("issuer_name"),
        text(F.col("issuer.issuerTradingSymbol")).alias("ticker"),
        text(F.col("owner.reportingOwnerId.rptOwnerName")).alias("owner_name"),
        owner_position(F.col("owner.reportingOwnerRelationship")).alias("position"),
        text(F.col("t.security")).alias("security"),
        F.col("t.transaction_date").try_cast("date").alias("transaction_date"),
        text(F.col("t.transaction_code")).alias("transaction_code"),
        plain_number(F.col("t.shares")).alias("shares"),
        plain_number(F.col("t.price_per_share")).alias("price_per_share"),
        "t.is_derivative",
        F.col("t.shares_after").try_cast("double").alias("shares_after"),
        F.when(F.col("t.is_derivative"), plain_number(F.col("t.exercise_price"))).alias("exercise_price"),
        F.col("t.expiration_date").try_cast("date").alias("expiration_date"),
    )


def _last_of_priority(priority: Column) -> Column:
    """Smallest first: priority documents from the last to the first, then the others from the first to the last."""
    return F.struct(F.when(priority, 0).otherwise(1).alias("p"), F.when(priority, -F.col("pos")).otherwise(F.col("pos")).alias("o"))


def pick_primary_document(documents: DataFrame, key: str = "accession_no") -> DataFrame:
    """The document of each filing (key, pos, name, type): the last with a high rank, else the first; index pages don't count."""
    name = F.lower("name")
    kind = F.coalesce("type", F.lit(""))
    good = F.regexp_like(name, F.lit(r"\.(xml|htm|html)$")) & ~F.endswith(name, F.lit("-index.html"))
    high = F.regexp_like(name, F.lit("form4|f345|10k|10q|8k")) | F.contains(F.upper(kind), F.lit("XML")) | F.regexp_like(kind, F.lit("10-K|10-Q|8-K"))
    return documents.filter(good).groupBy(key).agg(F.min_by("name", _last_of_priority(high)).alias("name"))


def pick_form4_xml(documents: DataFrame, key: str = "accession_no") -> DataFrame:
    """The ownership XML of each filing: the last named form4 or f345 or typed XML, else the first XML."""
    name = F.lower("name")
    high = F.contains(name, F.lit("form4")) | F.contains(name, F.lit("f345")) | F.contains(F.upper(F.coalesce("type", F.lit(""))), F.lit("XML"))
    return documents.filter(F.endswith(name, F.lit(".xml"))).groupBy(key).agg(F.min_by("name", _last_of_priority(high)).alias("name"))


#: Patterns of links to a filing's document, in order of preference, then of the first table and of a link in it.
LINKS = (
    r"""href=["'][^"']*(form4\.xml)["']""",
    r"""href=["'][^"']*(d\d+k\.htm)["']""",
    r"""href=["'][^"']*(dq\.htm)["']""",
    r"""href=["'][^"']*(\w+-\d{8}\.htm)["']""",
    r"""href=["'][^"']*(10-?[kq]\.htm)["']""",
    r"""href=["'][^"']*(primary_doc\.xml)["']""",
    r"""href=["'][^"']*(primary_doc\.htm)["']""",
)
FIRST_TABLE = r"(?is)<table.*?>(.*?)</table>"
TABLE_LINK = r"""(?i)href=["']([^"']+\.(?:htm|xml))["']"""


def html_document_link(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds link: by the first pattern that matches, else the first document link in a table, without its folders."""
    found = [F.nullif(F.regexp_extract(F.col(html), f"(?i){p}", 1), F.lit("")) for p in LINKS]
    table = F.regexp_extract(F.regexp_extract(F.col(html), FIRST_TABLE, 1), TABLE_LINK, 1)
    return pages.withColumn("link", F.coalesce(*found, F.nullif(F.element_at(F.split(table, "/"), -1), F.lit(""))))
