import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docketflow.functions.similarity import best_scores, best_window_score, first_reaching, hopeful, may_reach, score_maps, score_of, unsettled


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(a, b):
    if not a or not b:
        return 100.0 if not a and not b else 0.0

    def one(s, t):
        m, n = len(s), len(t)
        windows = [t[i:i + m] for i in range(n - m + 1)] + [t[:i] for i in range(1, m)] + [t[n - i:] for i in range(1, m)]
        return max(200 * lcs(s, w) / (m + len(w)) for w in windows if w)

    a, b = (a, b) if len(a) <= len(b) else (b, a)
    best = one(a, b)
    return max(best, one(b, a)) if len(a) == len(b) else best


@settings(max_examples=150, deadline=None)
@given(st.text("abc d", max_size=40), st.text("abc d", max_size=60))
def test_against_brute_force(a, b):
    assert abs(best_window_score(a, b) - brute(a, b)) < 1e-9


def test_long_patterns_and_cutoff():
    rng = random.Random(3)
    for _ in range(40):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 150)))
        b = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 200)))
        want = brute(a, b)
        assert abs(best_window_score(a, b) - want) < 1e-9
        for cutoff in (55, 62, 70):
            assert (best_window_score(a, b, cutoff, decide=True) >= cutoff) == (want >= cutoff)


def test_pinned_values():
    assert best_window_score("route", "the route is long") == 100.0
    assert best_window_score("", "x") == 0.0
    assert round(best_window_score("abcd", "abxd"), 6) == 75.0


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["abcd efgh", "zzz", ""], ["xx abcd efgh yy"]), (["abxd"], ["abcd"]), (["a"], [])],
                               "n array<string>, h array<string>")
    rows = df.select(unsettled(F.col("n"), F.col("h")).alias("u"), best_scores(F.col("n"), F.col("h"), 0.0).alias("s")).collect()
    assert rows[0]["u"] == ["zzz"] and rows[0]["s"][0] == 100.0 and rows[1]["s"] == [75.0] and rows[2]["s"] == [0.0]
    for cutoff, scores in ((60.0, [[100.0, 0.0, 100.0], [75.0], [100.0]]), (90.0, [[100.0, 0.0, 100.0], [0.0], [100.0]])):
        jobs = df.withColumn("u", F.when(F.size("h") > 0, unsettled(F.col("n"), F.col("h")))).withColumn("o", hopeful(F.col("u"), F.col("h"), cutoff))
        jobs = jobs.withColumn("s", score_maps([(F.col("o"), F.col("h"), cutoff), (F.lit(None).cast("array<string>"), F.col("h"), cutoff)])[0])
        got = jobs.select(F.transform("n", lambda x: score_of(x, F.col("u"), F.col("o"), F.col("s"))).alias("x"), "o").collect()
        assert [[x >= cutoff for x in r["x"]] for r in got] == [[x >= cutoff for x in xs] for xs in scores]
    assert got[0]["o"] == [] and got[1]["o"] == []  # pairs of letters rule both out, so nothing goes to Python
    first = df.select(first_reaching(F.col("n"), F.array(F.lit("zz"), F.lit("abcd efgh"), F.lit("")), 70.0).alias("f")).collect()
    assert [r["f"] for r in first] == [[1, 0, -1], [1], [1]]


def test_pairs_of_letters_never_rule_out_a_match(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 25)))
        b = list(a + "".join(rng.choice("abc") for _ in range(rng.randint(0, 12))))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        rows.append((a, "".join(b)))
    for cutoff in (62.0, 67.0, 80.0, 85.0, 90.0, 99.0):
        kept = spark.createDataFrame(rows, "a string, b string").select("a", "b", may_reach(F.col("a"), F.col("b"), cutoff).alias("k")).collect()
        assert all(r.k for r in kept if r.a and r.b and best_window_score(r.a, r.b) >= cutoff)
        assert cutoff < 80 or any(not r.k for r in kept)


def test_lower_first_keeps_long_texts(spark):
    from docketflow.functions.text import lower_first
    from pyspark.sql import functions as F

    long = "Word " + "x" * 2_100_000
    rows = spark.createDataFrame([(long,), ("W" + "o" * 2_100_000,), ("NASA",), ("",), ("A",)], "t string")
    got = [r.l for r in rows.select(lower_first(F.col("t")).alias("l")).collect()]
    assert got == ["word " + "x" * 2_100_000, "w" + "o" * 2_100_000, "NASA", "", "a"]


def test_lanes_on_either_side_of_their_limits(monkeypatch):
    rng = random.Random(11)
    from docketflow.functions import similarity as S

    for m in (1, 2, 7, 8, 9, 63, 64, 65, 127, 128, 129):
        for alphabet in ("ab", "abcdefgh 1%$", "é😀a"):
            a, b = ("".join(rng.choice(alphabet) for _ in range(n)) for n in (m, m + rng.randint(0, 60)))
            assert abs(best_window_score(a, b) - brute(a, b)) < 1e-9
    monkeypatch.setattr(S, "_LANE_BYTES", 256)
    a, b = "ab" * 30, "".join(rng.choice("ab") for _ in range(400))
    assert abs(best_window_score(a, b) - brute(a, b)) < 1e-9
