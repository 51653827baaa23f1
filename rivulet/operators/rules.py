"""Labels of days by rules, without a model: the baseline that decoding is held against.

Where cycles start is judged day by day, since each decision changes the next: one fold over a user's days, in order, with a
struct that holds what is known. All else is relational: periods from runs of bleeding days, pregnancies from the tests
between two starts, and labels from intervals of days, of which the last one put over a day names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = ("menstruation", "first_day", "preg_test")
LUTEAL, OVULATION_WINDOW = 12, 5
USUAL, BEFORE_ALL = 29.0, -29

#: What is known of a user's cycles by the evening of a day: days that start one; for all starts ever entered, whether they
#: end a pregnancy; the last start; the usual length; the first positive test of a pregnancy that goes on; what may have
#: ended it, and when.
_KNOWN = "starts array<int>, marks array<boolean>, last int, usual double, positive int, event int, kind string"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _set(s: Column, **new: Column) -> Column:
    for k, v in new.items():
        s = s.withField(k, v)
    return s


def _enter(s: Column, day: Column, pregnant: Column, if_: Column) -> Column:
    """``day`` entered as a start ``if_`` so."""
    return _set(s, starts=F.when(if_, F.concat(s["starts"], F.array(day))).otherwise(s["starts"]), marks=F.when(if_, F.concat(s["marks"], F.array(pregnant))).otherwise(s["marks"]))


def _judge(s: Column, d: Column) -> Column:
    """What the day tells: its length of cycle, and whether it may be a period or a declared first day."""
    length = d["t"] - s["last"]
    period = (d["m"] > 0) & (d["two"] > 1) & (d["before"] <= 1) & (length >= F.least(0.6 * s["usual"], F.lit(12.0)))
    return _set(s, length=length, period=period, declared=d["first"] & (length >= 21) & (d["before"] <= 2))


def _begin(s: Column, d: Column) -> Column:
    """A positive test begins a pregnancy, and takes back a start that came too late for it; else a period starts a cycle."""
    none = s["positive"].isNull()
    conceived = none & (d["test"] == 1)
    back = conceived & (s["length"] < F.least(F.lit(23.0), s["usual"] - 6)) & (F.size(s["starts"]) > 0)
    left = F.slice(s["starts"], F.lit(1), F.greatest(F.size(s["starts"]) - 1, F.lit(0)))
    cycle = none & ~conceived & (s["period"] | s["declared"])
    s = _set(
        _enter(s, d["t"], F.lit(False), cycle),
        last=F.when(cycle, d["t"]).when(back, F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit(BEFORE_ALL))).otherwise(s["last"]), positive=F.when(conceived, d["t"]).otherwise(s["positive"]),
    )
    return s.withField("starts", F.when(back, F.slice(s["starts"], F.lit(1), F.greatest(F.size(s["starts"]) - 1, F.lit(0)))).otherwise(s["starts"]))


def _signs(s: Column, d: Column) -> Column:
    """Which of the two kinds of signs of an end the day can be."""
    sign = F.when(d["first"], "first day").when(d["test"] == -1, "negative test").when(s["period"], "period").otherwise("")
    open_ = s["positive"].isNotNull()
    return _set(s, sign=F.when(open_ & (s["kind"] == ""), sign).otherwise(""), second=open_ & (s["kind"] != "") & (s["event"] != d["t"]))


def _first_event(s: Column, d: Column) -> Column:
    """A first sign ends the pregnancy if it comes late, else it waits."""
    seen = s["sign"] != ""
    late = seen & ((d["t"] - s["positive"] >= 2 * s["usual"]) | (s["length"] >= 3 * s["usual"]))
    return _set(
        _enter(s, d["t"], F.lit(True), late), event=F.when(seen, d["t"]).otherwise(s["event"]), kind=F.when(late, "").when(seen, s["sign"]).otherwise(s["kind"]),
        last=F.when(late, d["t"]).otherwise(s["last"]), positive=F.when(~late, s["positive"]),
    )


def _second_period(s: Column, d: Column) -> Column:
    """A period ends the pregnancy now, and at the first sign too if that lies a cycle back."""
    ends, cycle = s["second"] & s["period"], F.bround(1.75 * s["usual"])
    apart = (d["t"] - s["event"]).between(F.least(F.lit(21.0), cycle), F.greatest(F.lit(21.0), cycle))
    s = _enter(_enter(s, s["event"], F.lit(True), ends & apart), d["t"], ~apart, ends)
    return _set(s, last=F.when(ends, d["t"]).otherwise(s["last"]), positive=F.when(~ends, s["positive"]))


def _second_sign(s: Column, d: Column) -> Column:
    """Another sign ends the pregnancy at a first period; a positive test takes the first sign back."""
    ends = s["second"] & (s["kind"] == "period") & (d["first"] | (d["test"] == -1))
    back = s["second"] & (d["test"] == 1)
    return _set(_enter(s, s["event"], F.lit(True), ends), last=F.when(ends, s["event"]).otherwise(s["last"]), positive=F.when(~ends, s["positive"]), kind=F.when(ends | back, "").otherwise(s["kind"]))


def _learn(s: Column) -> Column:
    """With five starts that end no pregnancy, the median of the last three gaps of them is usual."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s["marks"]), F.lit(1))), lambda k: ~F.coalesce(F.try_element_at(s["marks"], k), F.lit(True)))

    def median(four: Column) -> Column:
        gaps = F.filter(F.zip_with(F.slice(four, 2, 3), F.slice(four, 1, 3), lambda b, a: b - a), lambda g: g.isNotNull())
        ordered = F.array_sort(gaps)
        at = lambda k: F.try_element_at(ordered, F.greatest(k, F.lit(1)).cast("int"))
        n = F.size(ordered)
        return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2.0)

    usual = _let(places, lambda p: F.when(F.size(p) > 4, median(F.transform(F.slice(p, -4, 4), lambda k: F.try_element_at(s["starts"], k)))))
    return s.withField("usual", F.coalesce(usual, s["usual"]))


def recorded(days: DataFrame, key: str = "seq_id") -> DataFrame:
    """Distinct recorded days with what the rules look at: t, m, first, test, the bleeding of the seven days ``before`` by calendar and of the ``two`` from this day."""
    of = Window.partitionBy(key).orderBy("t")
    m, first, test = F.coalesce(F.col("menstruation").cast("double"), F.lit(0.0)), F.coalesce("first_day", F.lit(False)), F.coalesce(F.col("preg_test").cast("int"), F.lit(0))
    plain = days.filter(F.col(key).isNotNull() & F.col("t").isNotNull()).select(key, F.col("t").cast("int").alias("t"), m.alias("m"), first.alias("first"), test.alias("test"))
    once = plain.withColumn("__n", F.row_number().over(Window.partitionBy(key, "t").orderBy("m", "first", "test"))).filter("__n = 1").drop("__n")
    return once.withColumns({"before": F.coalesce(F.sum("m").over(of.rangeBetween(-7, -1)), F.lit(0.0)), "two": F.sum("m").over(of.rangeBetween(0, 1))})


def cycle_starts(days: DataFrame, key: str = "seq_id", usual: float = USUAL) -> DataFrame:
    """Day 1 of each cycle: key, t.

    A period starts a cycle if it is new and the cycle is long enough for this user; so does a declared first day after a
    quiet week. From a positive test on, a first sign of an end (period, negative test, declared first day) ends the
    pregnancy if it comes two usual cycles after the test or three after the cycle's start; else it waits. The next
    period then ends it that day, and at the first sign too if that is 21 days to 1.75 usual cycles back; another sign
    ends it at the first one if that was a period; a positive test takes the first sign back. A period that ends a
    pregnancy as a second sign leaves the first one standing, so it is the first sign of the next pregnancy.
    """
    return _starts(recorded(days, key), key, usual)


def _starts(rows: DataFrame, key: str, usual: float) -> DataFrame:
    row = F.struct("t", "m", "first", "test", "before", "two")
    nothing = F.from_json(F.lit('{"starts": [], "marks": [], "kind": ""}'), _KNOWN)
    nothing = _set(nothing, last=F.lit(BEFORE_ALL), usual=F.lit(float(usual)), positive=F.lit(None).cast("int"), event=F.lit(0))

    def day(s: Column, d: Column) -> Column:
        with_day = lambda step: lambda x: step(x, d)
        for step in (_judge, _begin, _signs, _first_event, _second_period, _second_sign):
            s = _let(s, with_day(step))
        return _let(s, _learn).dropFields("length", "period", "declared", "sign", "second")

    known = rows.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(row)), nothing, day).alias("known"))
    return known.select(key, F.explode(F.array_distinct("known.starts")).alias("t"))


def periods(rows: DataFrame, key: str = "seq_id") -> DataFrame:
    """Adds to recorded days the last day of a period that would begin there: while bleeding goes on with gaps of a day at most; 5 days without records of any."""
    of = Window.partitionBy(key).orderBy("t")
    heavy = F.when(F.col("m") > 0.5, F.col("t"))
    before = F.last(heavy, True).over(of.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__new": (heavy.isNotNull() & (before.isNull() | (F.col("t") - before > 2))).cast("int"), "__some": F.max((F.col("m") > 0).cast("int")).over(of.rangeBetween(0, 4))})
    rows = rows.withColumn("__run", F.sum("__new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__stop", F.max(heavy).over(Window.partitionBy(key, "__run")))
    after = F.first(F.when(heavy.isNotNull(), F.struct("t", "__stop")), True).over(of.rowsBetween(0, Window.unboundedFollowing))
    end = F.when(F.col("__some") == 0, F.col("t") + 4).when(after["t"] - F.col("t") <= 2, after["__stop"]).otherwise(F.col("t"))
    return rows.withColumn("period_end", end).drop("__new", "__some", "__run", "__stop")


def cycles(days: DataFrame, key: str = "seq_id") -> DataFrame:
    """All cycles: key, number, begin, stop (the next start, missing for the last), period_end, the user's last recorded day, first positive test, length, kind.

    A cycle with a positive test is a pregnancy. 210 to 273 days make a birth and fewer a loss; after more the end is unknown.
    Until it has an end, one of under 210 days is ongoing. The kind of other cycles is missing.
    """
    rows = recorded(days, key)
    starts = _starts(rows, key, USUAL).withColumn("__start", F.lit(True))
    of = Window.partitionBy(key).orderBy("t")
    marked = periods(rows, key).join(starts, [key, "t"], "left")
    marked = marked.withColumn("number", F.count("__start").over(of.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last_day", F.max("t").over(Window.partitionBy(key)))
    found = marked.filter("number > 0").groupBy(key, "number").agg(F.min("t").alias("begin"), F.min_by("period_end", "t").alias("period_end"), F.max("last_day").alias("last_day"), F.min(F.when(F.col("test") > 0, F.col("t"))).alias("test"))
    found = found.withColumn("stop", F.lead("begin").over(Window.partitionBy(key).orderBy("number")))
    found = found.withColumn("length", F.coalesce("stop", F.col("last_day") + 1) - F.col("begin"))
    n = F.col("length")
    kind = F.when(F.col("stop").isNull() & (n < 210), "ongoing").when(n.between(210, 273), "birth").when(n < 210, "loss").otherwise("undefined")
    return found.withColumn("kind", F.when(F.col("test").isNotNull(), kind))


def _intervals() -> Column:
    """Intervals of one label each (low, high, label) of a cycle; later ones lie over earlier ones."""
    c = F.col
    put = lambda low, high, name, if_=True: F.when((F.lit(if_) if if_ is True else if_) & (low <= high), F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(name).alias("label")))
    begin, end, bled = c("begin"), F.coalesce("stop", c("last_day") + 1), c("period_end")
    pregnant, lost, undefined = c("kind").isNotNull(), c("kind") == "loss", c("kind") == "undefined"
    conception = begin + 14
    birth = F.when(undefined, begin + 252).when(c("kind") == "birth", end)
    till = F.coalesce(birth, end) - 1
    carried = pregnant & ~lost
    third = lambda n, name, high: put(F.greatest(begin + 1 + 84 * n, conception + 3), high, name, carried)
    nursing, usual = ~pregnant & (c("born") == True), ~pregnant & ~(c("born") == True) & c("stop").isNotNull()  # noqa: E712
    long_pause = c("stop").isNull() | (c("stop") - begin > 56)
    ovulation = c("stop") - LUTEAL - 2
    luteal = usual & (ovulation > bled + 1)
    return F.filter(
        F.array(
            put(conception, conception + 2, "postO", pregnant), put(conception - 1, conception - 1, "O", pregnant),
            put(conception + 3, end - 1, "PL", lost), put(end, end + 4, "L", lost),
            third(0, "PB1", F.least(begin + 84, till)), third(1, "PB2", F.least(begin + 168, till)), third(2, "PB3", till),
            put(birth, birth + 3, "B", carried & birth.isNotNull()), put(birth + 4, end - 1, "BF", undefined & (c("length") > 322)), put(birth + 4, end - 1, "PP", undefined & (c("length") <= 322)),
            put(begin + 4, end - 1, "BF", nursing & long_pause), put(begin + 4, end - 1, "PP", nursing & ~long_pause),
            put(bled + 1, ovulation - OVULATION_WINDOW - 1, "lE", usual), put(F.greatest(bled + 1, ovulation - OVULATION_WINDOW), ovulation - 2, "hE", usual),
            put(ovulation - 1, ovulation - 1, "preO", luteal), put(ovulation, ovulation, "O", luteal), put(ovulation + 1, ovulation + 2, "postO", luteal), put(ovulation + 3, c("stop") - 1, "Lut", luteal),
            put(bled + 1, c("stop") - 1, "Ano", usual & ~(ovulation > bled + 1)), put(begin, bled, "M"),
        ),
        lambda x: x.isNotNull(),
    )


def rule_based_labels(days: DataFrame, key: str = "seq_id") -> DataFrame:
    """Labels of all recorded days: key, t, label (a state name of the cycle model, "" where the rules say nothing)."""
    known = cycles(days, key)
    before = F.lag("kind").over(Window.partitionBy(key).orderBy("number"))
    put = known.withColumn("born", F.coalesce(before == "birth", F.lit(False))).select(key, "number", "last_day", F.posexplode(_intervals()).alias("place", "put"))
    named = put.filter(F.col("put.low") <= F.col("last_day")).select(key, F.explode(F.sequence("put.low", F.least("put.high", "last_day"))).alias("t"), F.struct("number", "place", F.col("put.label").alias("label")).alias("named"))
    named = named.groupBy(key, "t").agg(F.max("named").alias("named"))
    recorded_days = days.filter(F.col(key).isNotNull() & F.col("t").isNotNull()).select(key, F.col("t").cast("int").alias("t")).distinct()
    return recorded_days.join(named, [key, "t"], "left").select(key, "t", F.coalesce("named.label", F.lit("")).alias("label"))
