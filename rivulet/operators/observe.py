"""From raw tracking records to a dense panel of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_position, clamp, if_else, level, lookup
from .sequence import densify
from .tables import with_dominant

BLEEDING = ("none", "spotting", "light", "medium", "heavy")
MUCUS = ("none", "creamy", "fertile", "very_fertile", "sticky")
# --- fixed values: kinds of fluid with their scores and levels, amounts, codes of sex, states in records of durations,
# and plausible temperatures (degrees Fahrenheit) with the score from which fluid is fertile ------------
FLUID_KINDS = [
    ("none", 0, "none"),
    ("sticky_little", 0, "sticky"),
    ("sticky_medium", 0, "sticky"),
    ("sticky_lots", 0, "sticky"),
    ("creamy_little", 0.1, "creamy"),
    ("creamy_medium", 0.2, "creamy"),
    ("creamy_lots", 0.3, "fertile"),
    ("eggwhite_little", 0.5, "fertile"),
    ("eggwhite_medium", 0.9, "very_fertile"),
    ("eggwhite_lots", 1, "very_fertile"),
    ("watery_little", 0.5, "very_fertile"),
    ("watery_medium", 0.9, "very_fertile"),
    ("watery_lots", 1, "very_fertile"),
]
AMOUNTS = ("little", "medium", "lots")
FLUIDS = ("creamy", "sticky", "eggwhite", "watery")  # of several on one day, the last counts
SEX = (None, "protected", "unprotected", "withdrawal", "insemination")
SEX_SHORT = (None, "prot", "unprot", "WD", "insem")
STATE_GROUPS = {"hM": "M", "lM": "M", "Rise": "Lut", "Ep": "Lut", "lP": "Lut", "hP": "Lut"}
PLAUSIBLE, FERTILE = (95.0, 101.0), 0.5
# --- end of the fixed values ---------------------------------------------------------------------------
MUCUS_OF_KIND = {name: category for name, _, category in FLUID_KINDS}
TEMP_LIMIT = 1.5


def format_days(days: DataFrame, user: str = "user_id", date: str = "date") -> DataFrame:
    """Codes of raw days to values: tests to -1, 0, 1; bleeding with half steps; fluid kind; day number.

    Of several fluids of one day the last of creamy, sticky, eggwhite, watery counts.
    """

    def test(x: str) -> Column:
        return if_else(F.col(x) == 2, F.lit(-1), F.col(x))

    spot = F.col("spotting") & (F.col("menstruation") == 0)
    kind = F.when(F.coalesce(F.col("no_fluid"), F.lit(False)), F.lit("none"))
    for fluid in FLUIDS:
        code = F.col(f"fluid_{fluid}")
        kind = F.when(code > 0, F.concat_ws("_", F.lit(fluid), by_position(code, AMOUNTS))).otherwise(kind)
    out = days.withColumns({"LH": test("opk"), "preg_test": test("preg_test")})
    out = out.withColumn("bleeding", F.col("menstruation") + if_else(spot, F.lit(0.5), F.lit(0.0))).withColumn("mucus_type", kind)
    out = out.withColumn("mucus_category", F.split_part("mucus_type", F.lit("_"), F.lit(1)))
    out = out.withColumn("mucus_amount", level(F.split_part("mucus_type", F.lit("_"), F.lit(-1)), ("none", *AMOUNTS)).cast("int") - 1)
    out = out.withColumns({"sex": by_position("sex", SEX, first=0), "sex_short": by_position("sex", SEX_SHORT, first=0)})
    return out.withColumn("rel_date", F.datediff(date, F.min(date).over(Window.partitionBy(user))) + 1)


def bleeding_label(score: Column) -> Column:
    return F.when(score == 0, "none").when(score == 0.5, "spotting").when(score == 1, "light").when(score == 2, "medium").when(score == 3, "heavy")


def test_label(x: Column) -> Column:
    return F.when(x == 1, "pos").when(x == -1, "neg")


def numeric_observations(days: DataFrame, user: str = "user_id", t: str = "rel_date", plausible: tuple[float, float] = PLAUSIBLE, limit: float = TEMP_LIMIT) -> DataFrame:
    """Formatted days as numbers, day by day as recorded: seq_id, t, LH, preg, mucus, temp, fmucus.

    Tests are 1 and 0, missing where none was made. Fluid has the score of its kind, and 0 on days of heavy bleeding.
    Temperatures that are questionable, oddly repeated or not plausible are missing, the others are relative to the user's
    median within ``limit``, and missing on days of heavy bleeding. ``fmucus`` is 1 where fluid was fertile on this day, the
    one before or the one after, and 0 on the first and last.
    """
    score = F.element_at(F.create_map(*[x for name, s, _ in FLUID_KINDS for x in (F.lit(name), F.lit(float(s)))]), F.col("mucus_type"))
    heavy = F.coalesce(F.col("bleeding") == 3, F.lit(False))
    sure = F.when(~F.coalesce("questionable_temp", F.lit(False)), F.col("temperature"))
    rows = days.select(F.col(user).alias("seq_id"), F.col(t).cast("int").alias("t"), "LH", "preg_test", score.alias("score"), heavy.alias("heavy"), sure.alias("sure"))
    rows = with_dominant(rows, "seq_id", "sure")
    rows = rows.withColumn("sure", F.when(F.col("sure").between(*plausible) & ~F.coalesce(F.col("sure") == F.col("odd"), F.lit(False)), F.col("sure")))
    temp = clamp(F.col("sure") - F.percentile("sure", 0.5).over(Window.partitionBy("seq_id")), -limit, limit)
    result = lambda x: F.when(F.col(x) == 1, 1.0).when(F.col(x) == -1, 0.0)
    rows = rows.withColumns({"temp": temp, "mucus": F.when(F.col("heavy"), 0.0).otherwise(F.col("score"))})
    near = Window.partitionBy("seq_id").orderBy("t").rowsBetween(-1, 1)
    fertile = F.when((F.count(F.lit(1)).over(near) == 3) & F.coalesce(F.max("mucus").over(near) >= FERTILE, F.lit(False)), 1).otherwise(0)
    return rows.select("seq_id", "t", result("LH").alias("LH"), result("preg_test").alias("preg"), "mucus", F.when(~F.col("heavy"), F.col("temp")).alias("temp"), fertile.alias("fmucus"))


def prepare_obs(days: DataFrame, user: str = "user_id", t: str = "rel_date", limit: float = TEMP_LIMIT, missing_level: bool = False) -> DataFrame:
    """Formatted days to dense observations: seq_id, t, bleeding, mucus, temp, LH, preg.

    A day without a bleeding report but with a row had none. A declared first day has medium bleeding at least. A
    temperature that is marked questionable, or that a user reports more than five times as often as any other, is
    missing; the others are centred on the user's median and clamped. With ``missing_level`` missing categories
    become the level "missing" and days without a row have no bleeding.
    """
    rows = days.select(F.col(user).alias("seq_id"), F.col(t).cast("int").alias("t"), "bleeding", "first_day", "mucus_type", "temperature", "questionable_temp", "LH", "preg_test")
    present = densify(with_dominant(rows, "seq_id", "temperature").withColumn("__there", F.lit(True)), "seq_id", "t")
    score = F.when(F.col("__there"), F.coalesce("bleeding", F.lit(0.0)))
    score = F.when(F.coalesce("first_day", F.lit(False)) & (F.coalesce(score, F.lit(0.0)) < 1), F.lit(2.0)).otherwise(score)
    kept = F.when(~F.coalesce("questionable_temp", F.lit(False)) & ~F.coalesce(F.col("temperature") == F.col("odd"), F.lit(False)), F.col("temperature"))
    out = present.withColumn("__kept", kept)
    middle = F.percentile("__kept", 0.5).over(Window.partitionBy("seq_id"))
    out = out.withColumn("temp", clamp(F.col("__kept") - middle, -limit, limit))
    found = {"bleeding": bleeding_label(score), "mucus": lookup("mucus_type", MUCUS_OF_KIND), "LH": test_label(F.col("LH")), "preg": test_label(F.col("preg_test"))}
    if missing_level:
        found = {k: F.coalesce(v, F.lit("none" if k == "bleeding" else "missing")) for k, v in found.items()}
    return out.select("seq_id", "t", *[v.alias(k) for k, v in found.items()], "temp").select("seq_id", "t", "bleeding", "mucus", "temp", "LH", "preg")


def build_users(days: DataFrame, accounts: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """One row for each user: what their accounts say (first known value, joined or averaged), and counts of their records."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    mean = lambda c: F.avg(c).alias(c)
    known = accounts.groupBy(F.col("id").alias("user_id")).agg(
        joined("objective").alias("objective"), joined(F.year("birth_day").cast("string")).alias("birth_year"), *[mean(c) for c in ("average_cycle", "average_luteal", "average_period")], (F.count(F.lit(1)) > 1).alias("duplicated")
    )
    counts = days.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.count("temperature").alias("n_temp"), F.count("mucus_type").alias("n_mucus"), F.count_if(F.col("preg_test") != 0).alias("n_preg_tests"), F.count_if(F.col("LH") != 0).alias("n_LH")
    )
    out = counts.join(known, "user_id", "left")
    if cycles is not None:
        out = out.join(cycles.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_cycles"), F.count_if("pregnancy").alias("n_pregnancies")), "user_id", "left")
    return out


def tracking_density(days: DataFrame, user: str = "user_id", t: str = "rel_date", span: int = 180, least: int = 150) -> DataFrame:
    """By user: most days tracked within any ``span`` days, and whether that is at least ``least``."""
    ahead = F.count(F.lit(1)).over(Window.partitionBy(user).orderBy(t).rangeBetween(0, span - 1))
    most = days.select(user, t).distinct().withColumn("n", ahead).groupBy(user).agg(F.max("n").alias("most"))
    return most.withColumn("dense", F.col("most") >= least)



def state_durations(days: DataFrame) -> DataFrame:
    """Days by cycle and state, with states of one phase together; cycles with a luteal phase of exactly 2 days are left out."""
    counted = days.groupBy("cycle_id", "states").agg(F.count(F.lit(1)).alias("n"))
    together = counted.withColumn("hsmm_states", F.coalesce(lookup("states", STATE_GROUPS), F.col("states"))).groupBy("cycle_id", "hsmm_states").agg(F.sum("n").alias("n_days"))
    odd = together.filter("hsmm_states = 'Lut' and n_days = 2").select("cycle_id")
    return together.join(odd, "cycle_id", "left_anti")


def temperature_profile(cycles: DataFrame, days: DataFrame, least: int = 210, most: int = 280) -> DataFrame:
    """Median temperature by cycle-day over cycles with a pregnancy to term, relative to each cycle's days 5 to 13."""
    term = cycles.filter("pregnancy").withColumn("length", F.datediff("end", "start") + 1).filter(F.col("length").between(least, most))
    each = term.select("user_id", "start", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("cycle_day"))
    each = each.withColumn("date", F.expr("date_add(start, cycle_day - 1)")).join(days.select("user_id", "date", "temperature"), ["user_id", "date"])
    base = F.percentile(F.when(F.col("cycle_day").between(5, 13), F.col("temperature")), 0.5).over(Window.partitionBy("user_id", "start"))
    return each.withColumn("relative", F.col("temperature") - base).groupBy("cycle_day").agg(F.percentile("relative", 0.5).alias("median"), F.count("relative").alias("n"))
