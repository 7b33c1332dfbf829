"""Company-registry linkage: boards, common control, address farms, rail crossover, the findings report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry_text as R

# Thresholds of the registry findings.
YOUNG_DAYS, LOW_PAID_UP, STALE_YEARS, DIRECTOR_LIMIT, BUSY_DIRECTOR, ADDRESS_FARM, ADDRESS_FARM_HIGH, BATCH_DAYS = 180, 100_000.0, 2, 20, 10, 5, 20, 365
RANK = "CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def current_directorships(directorships: DataFrame, as_of: str) -> DataFrame:
    return directorships.where(F.col("ceased_on").isNull() | (F.col("ceased_on") > F.lit(as_of).cast("date")))


def director_load(directorships: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """Per director: current directorships, and how many of all their companies are struck off."""
    now = F.col("ceased_on").isNull() | (F.col("ceased_on") > F.lit(as_of).cast("date"))
    s = F.lower(F.coalesce("status", F.lit("")))
    x = directorships.join(companies.select("cin", "status"), "cin", "left").withColumn("struck", (s.contains("strike") | s.contains("struck")).cast("int"))
    return x.groupBy("din").agg(F.count(F.when(now, 1)).alias("current_n"), F.sum("struck").alias("struck_n"), F.max("disqualified").alias("disqualified"))


def common_control(directorships: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """Per company: other companies that share two or more current directors, and how many of them were incorporated within
    a year of it.

    Companies with the same board are one group: only distinct boards are compared (through the director pairs they
    contain), and each board enters as its counts per incorporation date, so companies are never paired with each other.
    """
    board = current_directorships(directorships, as_of).groupBy("cin").agg(F.sort_array(F.collect_set("din")).alias("dins")).where(F.size("dins") >= 2)
    b = board.withColumn("board", F.array_join("dins", "|")).join(companies.select("cin", "incorporated_on"), "cin", "left")
    boards = b.select("board", "dins").distinct()
    pair = F.expr("flatten(transform(dins, (x, i) -> transform(slice(dins, i + 2, size(dins)), y -> concat(x, '+', y))))")
    pairs = boards.select("board", F.explode(pair).alias("pair"))
    linked = pairs.join(pairs.withColumnRenamed("board", "other"), "pair").select("board", "other").distinct()
    per_date = b.groupBy("board", "incorporated_on").agg(F.count(F.lit(1)).alias("n"))
    size = per_date.groupBy("board").agg(F.sum("n").alias("n"))
    group = linked.join(size.withColumnRenamed("board", "other"), "other").groupBy("board").agg(F.sum("n").alias("group_n"))
    near = (
        per_date.where("incorporated_on IS NOT NULL").select("board", F.col("incorporated_on").alias("mine")).join(linked, "board")
        .join(per_date.select(F.col("board").alias("other"), F.col("incorporated_on").alias("theirs"), "n"), "other")
        .where(F.abs(F.datediff("mine", "theirs")) <= BATCH_DAYS).groupBy("board", F.col("mine").alias("incorporated_on")).agg(F.sum("n").alias("near_n")))
    out = b.join(group, "board").join(near, ["board", "incorporated_on"], "left")
    return out.select("cin", (F.col("group_n") - 1).alias("group_n"), (F.coalesce("near_n", F.lit(1)) - 1).alias("batch_n"))


def address_counts(companies: DataFrame) -> DataFrame:
    """Per company: how many companies (itself included) share its address key. Counted per key, never paired."""
    c = companies.select("cin", R.address_key(F.col("address")).alias("address_key")).where("address_key IS NOT NULL")
    n = c.groupBy("address_key").agg(F.count(F.lit(1)).alias("at_address"))
    return c.join(n, "address_key").select("cin", "address_key", "at_address")


def flagged_links(applicants: DataFrame, directorships: DataFrame, companies: DataFrame, vpa_status: DataFrame, as_of: str) -> DataFrame:
    """Per applicant: distinct flagged settlement VPAs of itself, of companies of its current directors, and at its address.

    The links are counted per board and per (board, address), never listed per applicant: everything flagged at the own
    address, plus what the board reaches elsewhere.
    """
    f = vpa_status.select("cin", "vpa").distinct()
    addr = companies.select("cin", R.address_key(F.col("address")).alias("k")).where("k IS NOT NULL")
    flagged = f.join(addr, "cin", "left")
    at_addr = flagged.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("addr_n"))
    own = f.groupBy("cin").agg(F.count(F.lit(1)).alias("own_n"))
    board = current_directorships(directorships, as_of).join(applicants.select("cin"), "cin", "left_semi").groupBy("cin").agg(F.sort_array(F.collect_set("din")).alias("dins")).withColumn("board", F.array_join("dins", "|"))
    reach = board.select("board", F.explode("dins").alias("din")).distinct().join(directorships.select("din", "cin"), "din").join(flagged, "cin").select("board", "cin", "vpa", "k").distinct()
    total = reach.groupBy("board").agg(F.count(F.lit(1)).alias("board_n"))
    same = reach.where("k IS NOT NULL").groupBy("board", "k").agg(F.count(F.lit(1)).alias("same_n"))
    x = applicants.select("cin").distinct().join(board.select("cin", "board"), "cin", "left").join(addr, "cin", "left").join(own, "cin", "left")
    x = x.join(at_addr, "k", "left").join(total, "board", "left").join(same, ["board", "k"], "left").na.fill(0, ["own_n", "addr_n", "board_n", "same_n"])
    n = F.when(F.col("k").isNotNull(), F.col("addr_n") + F.col("board_n") - F.col("same_n")).otherwise(F.greatest("own_n", "board_n"))
    return x.select("cin", n.alias("n")).where("n > 0")


def findings(applicants: DataFrame, companies: DataFrame, directorships: DataFrame, vpa_status: DataFrame, as_of: str) -> DataFrame:
    """(cin, severity, code, n): all findings for a batch of applicants. Low findings never change a decision."""
    a = applicants.select(R.normal_cin(F.col("cin")).alias("cin")).distinct()
    ok = a.where(R.valid_company_id(F.col("cin")))
    day = F.lit(as_of).cast("date")
    c = ok.join(companies.withColumn("here", F.lit(True)), "cin", "left")
    age = F.datediff(day, "incorporated_on")
    def f(cond, sev, code, n=None):
        sev = F.lit(sev) if isinstance(sev, str) else sev
        return F.when(cond, F.struct(sev.alias("severity"), F.lit(code).alias("code"), (F.lit(1) if n is None else n).cast("bigint").alias("n")))
    sev = R.status_severity(F.col("status"))
    self_found = c.select("cin", F.inline(F.filter(F.array(
        f(F.col("here").isNull(), "medium", "not_in_registry"), f(sev.isNotNull(), sev, "inactive_status"), f(age < YOUNG_DAYS, "medium", "young_company", age),
        f(F.col("paid_up_capital") <= LOW_PAID_UP, "low", "low_paid_up"), f((F.year(day) - F.col("last_annual_return") > STALE_YEARS) & (age > 365 * STALE_YEARS), "medium", "stale_filings", F.col("last_annual_return"))), lambda x: x.isNotNull())))
    now = F.col("ceased_on").isNull() | (F.col("ceased_on") > day)
    seats = directorships.join(ok, "cin", "left_semi")
    size = seats.groupBy("cin").agg(F.count(F.lit(1)).alias("all_n"), F.count(F.when(now, 1)).alias("now_n"))
    boards = ok.join(size, "cin", "left").select("cin", F.inline(F.filter(F.array(f(F.col("all_n").isNull(), "low", "no_director_data"), f((F.col("all_n") > 0) & (F.col("now_n") == 0), "medium", "no_current_directors")), lambda x: x.isNotNull())))
    load = director_load(directorships, companies, as_of)
    s = F.lower(F.coalesce("status", F.lit("")))
    mine = companies.select("cin", (s.contains("strike") | s.contains("struck")).cast("int").alias("own_struck"))
    seat = current_directorships(seats, as_of).select("cin", "din").join(load, "din").join(mine, "cin", "left")
    others = F.col("struck_n") - F.coalesce("own_struck", F.lit(0))
    per_person = seat.select("cin", F.inline(F.filter(F.array(
        f(F.col("disqualified") == 1, "high", "disqualified_director"), f(F.col("current_n") > DIRECTOR_LIMIT, "high", "over_director_limit"),
        f((F.col("current_n") > BUSY_DIRECTOR) & (F.col("current_n") <= DIRECTOR_LIMIT), "medium", "busy_director"), f(others >= 2, "medium", "director_of_struck_off")), lambda x: x.isNotNull())))
    people = per_person.groupBy("cin", "severity", "code").agg(F.count(F.lit(1)).alias("n"))
    cc = common_control(directorships, companies, as_of).join(ok, "cin", "left_semi").where("group_n >= 1").select(
        "cin", F.when(F.col("batch_n") >= 2, "medium").otherwise("low").alias("severity"), F.when(F.col("batch_n") >= 2, "batch_incorporation").otherwise("common_control").alias("code"), F.when(F.col("batch_n") >= 2, F.col("batch_n")).otherwise(F.col("group_n")).alias("n"))
    # the reference list of neighbours is cut at 200, which does not change the bands below
    farm = address_counts(companies).join(ok, "cin", "left_semi").where(F.col("at_address") >= ADDRESS_FARM).select(
        "cin", F.when(F.col("at_address") >= ADDRESS_FARM_HIGH, "high").otherwise("medium").alias("severity"), F.lit("address_farm").alias("code"), F.col("at_address").alias("n"))
    links = flagged_links(ok, directorships, companies, vpa_status, as_of).select("cin", F.lit("high").alias("severity"), F.lit("linked_account_flagged").alias("code"), "n")
    bad = a.where(~R.valid_company_id(F.col("cin"))).select("cin", F.lit("medium").alias("severity"), F.lit("invalid_cin").alias("code"), F.lit(1).cast("bigint").alias("n"))
    out = bad
    for part in (self_found, boards, people, cc, farm, links):
        out = out.unionByName(part.select("cin", "severity", "code", F.col("n").cast("bigint").alias("n")))
    return out


def decide(found: DataFrame, applicants: DataFrame) -> DataFrame:
    top = found.groupBy("cin").agg(F.max(F.expr(RANK)).alias("top"), F.count(F.lit(1)).alias("findings"))
    a = applicants.select(R.normal_cin(F.col("cin")).alias("cin")).distinct().join(top, "cin", "left")
    return a.select("cin", F.coalesce("findings", F.lit(0)).alias("findings"), F.when(F.col("top") == 2, "hold").when(F.col("top") == 1, "review").otherwise("approve").alias("decision"))


def merge_decisions(transactions: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, decision, reason) x (key, decision, first_text): the stricter one wins and the reason says where it came from."""
    rank = "CASE {0} WHEN 'hold' THEN 2 WHEN 'review' THEN 1 ELSE 0 END"
    r = registry.select("key", F.col("decision").alias("r_decision"), "first_text")
    x = transactions.join(r, "key", "left").withColumn("tr", F.expr(rank.format("decision"))).withColumn("rr", F.coalesce(F.expr(rank.format("r_decision")), F.lit(0)))
    stricter = F.col("rr") > F.col("tr")
    reg = F.concat(F.lit("Registry: "), F.col("first_text"))
    return x.select(
        "key", F.when(stricter, F.col("r_decision")).otherwise(F.col("decision")).alias("decision"),
        F.when(stricter, F.coalesce(reg, F.col("reason"))).when((F.col("rr") > 0) & F.col("first_text").isNotNull(), F.concat("reason", F.lit(" "), reg)).otherwise(F.col("reason")).alias("reason"))
