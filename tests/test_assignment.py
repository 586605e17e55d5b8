import random

from docketflow.operators import assignment as A
from docketflow.operators.skew import first_per_group_salted, running_total
from pyspark.sql import functions as F


def loop(rounds, subs, users, held):
    """Submission by submission, least loaded first."""
    out = []
    for rid, org, per in rounds:
        judges = sorted(u[0] for u in users if u[1] == org and u[2] == "judge" and u[3])
        load = {j: 0 for j in judges}
        for r, _, j in held:
            if r == rid and j in load:
                load[j] += 1
        for sid in sorted(s[0] for s in subs if s[1] == rid):
            taken = {j for _, s, j in held if s == sid}
            while len(taken) < per:
                free = [j for j in judges if j not in taken]
                if not free:
                    break
                j = min(free, key=lambda x: (load[x], x))
                taken.add(j)
                load[j] += 1
                out.append((rid, sid, j))
    return sorted(out)


def frames(spark, rounds, subs, users, held):
    return (
        spark.createDataFrame(rounds, "id long, organization_id long, judges_per_submission int"),
        spark.createDataFrame(subs, "id long, round_id long"),
        spark.createDataFrame(users, "id long, organization_id long, role string, is_active boolean"),
        spark.createDataFrame(held, "round_id long, submission_id long, judge_id long"),
    )


def case(rng, held_share):
    rounds = [(r, r % 2, rng.randint(1, 4)) for r in range(6)]
    subs = [(100 * r + i, r) for r in range(6) for i in range(rng.randint(0, 40))]
    users = [(u, u % 2, "judge" if u % 7 else "organizer", u % 5 != 0) for u in range(1, rng.randint(6, 26))]
    judges = [u[0] for u in users]
    held = {(r, s, rng.choice(judges)) for s, r in subs if rng.random() < held_share for _ in range(rng.randint(1, 3))}
    return rounds, subs, users, sorted(held)


def test_auto_assign_equals_the_loop(spark):
    for seed, share in ((1, 0.3), (2, 0.8), (3, 0.05)):
        data = case(random.Random(seed), share)
        got = sorted(tuple(r) for r in A.auto_assign(*frames(spark, *data)).collect())
        assert got == loop(*data)


def test_empty_rounds_closed_form(spark):
    rounds, subs, users, _ = case(random.Random(9), 0)
    r, s, u, _ = frames(spark, rounds, subs, users, [(0, 0, 0)])
    assert sorted(tuple(x) for x in A.auto_assign_empty(r, s, u).collect()) == loop(rounds, subs, users, [])


def test_running_total_over_blocks(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.randint(0, 5)) for k in "ab" for p in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k string, p long, v int")
    got = {(r.k, r.p): r.before for r in running_total(df, ["k"], "p", {"before": F.col("v")}, levels=(64, 16)).collect()}
    for k in "ab":
        total = 0
        for _, p, v in sorted(x for x in rows if x[0] == k):
            assert got[(k, p)] == total
            total += v


def test_running_total_over_sparse_positions(spark):
    rng = random.Random(6)
    places = sorted({rng.choice((-1, 1)) * rng.getrandbits(rng.choice((4, 20, 62))) for _ in range(1500)})
    df = spark.createDataFrame([("hot", p, 1) for p in places], "k string, p long, v int")
    rows = running_total(df, ["k"], "p", {"before": F.col("v")})
    assert [r.before for r in rows.orderBy("p").collect()] == list(range(len(places)))


def test_chosen_judges_and_seats(spark):
    rounds, subs, users, _ = case(random.Random(12), 0)
    r, s, u, _ = frames(spark, rounds, subs, users, [(0, 0, 0)])
    some = [x for x in users if x[0] % 2]
    chosen = spark.createDataFrame([(x[0],) for x in some], "judge_id long")
    got = sorted(tuple(x) for x in A.auto_assign_empty(r, s, u, chosen, 2).collect())
    assert got == loop([(rid, org, 2) for rid, org, _ in rounds], subs, some, [])


def test_salted_first_rows(spark):
    rows = [(g, i, 3 + g) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, n int")
    got = first_per_group_salted(df, ["g"], [F.desc("i")], "n", ["i"], salts=8).collect()
    assert sorted((r.g, r.i) for r in got) == sorted((g, i) for g in range(3) for i in range(200 - 3 - g, 200))
