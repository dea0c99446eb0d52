import math
import random


from docfields.operators.rollup import rollup, rollup_both
from tests import model


def test_numbers_are_summed_and_strings_listed(spark):
    rows = [("total", "1,5"), ("total", "2"), ("total", "x"), ("total", "x"), ("name", "a b"), ("name", "ab"),
            ("gone", None), (None, "3")]
    summed, strings = rollup(spark.createDataFrame(rows, "key string, value string"))
    assert {tuple(r) for r in summed.collect()} == {("total", 3.5)}
    assert sorted(map(tuple, strings.collect())) == [("name", "ab"), ("total", "x")]


def test_grouping_locale_and_exact_numbers(spark):
    rows = [("p", "total", "1.000,10"), ("q", "total", "0,20"), ("q", "total", "0,10")]
    df = spark.createDataFrame(rows, "image string, key string, value string")
    summed, _ = rollup(df, by=["image"], locale="es", number_type="decimal(18,2)")
    assert {(r["image"], str(r["value"])) for r in summed.collect()} == {("p", "1000.10"), ("q", "0.30")}


def test_order_and_partitioning_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), "".join(rng.choice("12., x") for _ in range(rng.randint(0, 4)))) for _ in range(3000)]
    totals, texts = {}, set()
    for key, value in rows:
        number, text = model.number(value)
        if number is None:
            texts.add((key, text))
        else:
            totals[key] = totals.get(key, 0) + number
    for partitions in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key string, value string").repartition(partitions)
        summed, strings = rollup(df)
        assert {r["key"]: round(r["value"], 6) for r in summed.collect()} == {k: round(v, 6) for k, v in totals.items()}
        listed = [tuple(r) for r in strings.collect()]
        assert len(listed) == len(texts) and set(listed) == texts
        assert rollup_both(df).count() == len(totals) + len(texts)


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(8)
    numbers = {
        "far": [1e16, 1.0, -1e16], "money": [rng.randrange(10**9) / 100 for _ in range(2000)],
        "wide": [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-12, 30) for _ in range(2000)],
        "cancel": [x for _ in range(300) for x in [rng.random() * 1e25] for x in (x, -x)] + [0.1, 0.2], "one": [0.1], "minus": [-0.1] * 10,
        "huge": [1e300, 2.5], "tiny": [5e-324], "edge": [2.0 ** 40, -1.0, 2.0 ** 80, 2.0 ** -40, -(2.0 ** 120)],
    }
    rows = [(k, repr(x)) for k, xs in numbers.items() for x in xs]
    seen = set()
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key string, value string").repartition(parts)
        found = {r["key"]: r["total"] for r in rollup_both(df).where("text is null").collect()}
        seen.add(tuple(sorted(found.items())))
    assert len(seen) == 1
    for key, xs in numbers.items():
        exact = math.fsum(xs)
        assert abs(found[key] - exact) <= 4 * math.ulp(exact), key
    assert found["far"] == 1.0 and found["cancel"] == math.fsum([0.1, 0.2]) and found["one"] == 0.1 and found["edge"] == math.fsum(numbers["edge"])
