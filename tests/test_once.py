"""What is costly a row is done once and spread; feeds keep no state a key."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F
from test_streams import T0, send

from cartwise.common import spread
from cartwise.functions import web
from cartwise.operators import catalog as C
from cartwise.streaming import jobs as J
from cartwise.streaming.changes import ChangeTable


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_spread_by_their_number(spark):
    df = spark.range(12_000).coalesce(1)
    assert spread(df, 12_000).rdd.getNumPartitions() == 3
    assert spread(df, 4_000).rdd.getNumPartitions() == 1


CARD = '<li class="product post-{0}"><a href="https://x/toode/{0}/"><img src="//cdn/{1}.jpg"><h2 class="product-title">{2}</h2></a><span class="price"><ins><bdi>{3} €</bdi></ins></span></li>'


def test_shop_cards_are_read_once(spark):
    page = "<html>" + CARD.format(7, "4740000000017", "Piim 1 l", "1.25") + '<li class="product product-category">x</li>' + CARD.format(8, "pic", "", "2.00") + CARD.format(9, "pic", "Leib", "") + "</html>"
    got = web.extract_shop_cards(spark.createDataFrame([(1, page), (2, None), (3, "none")], "page_id long, html string"))
    assert plan(got).count("woocommerce-loop") == 1  # 42 before: filters on rows read every card again
    want = [
        (1, 0, "Piim 1 l", "https://x/toode/7/", "https://cdn/4740000000017.jpg", "7", "4740000000017", "4740000000017", "1 l"),
        (1, 3, "Leib", "https://x/toode/9/", "https://cdn/pic.jpg", "9", None, "9", ""),
    ]
    assert rows(got.select("page_id", "position", "name", "url", "image_url", "sku", "ean_raw", "ext_id", "size_text")) == want
    assert [str(r["price"]) for r in got.orderBy("position").collect()] == ["1.25", "None"]


def test_json_cards_are_read_once(spark):
    card = '<div data-gtm-eec-product="{&quot;id&quot;:&quot;%s&quot;,&quot;name&quot;:&quot;%s&quot;,&quot;price&quot;:2.5}"></div>'
    page = "<html>" + card % ("7", "Sai 300g") + card % ("", "x") + card % ("8", " ") + "<div data-gtm-eec-product='{bad'></div>" + card % ("9", "Juust")
    got = web.extract_cards(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    assert not [line for line in plan(got).splitlines() if "Filter" in line and "from_json" in line]
    assert rows(got.select("position", "ext_id", "name", "price", "size_text")) == [(0, "7", "Sai 300g", 2.5, "300 g"), (4, "9", "Juust", 2.5, "")]


def test_canonical_names_are_made_once(spark):
    products = spark.createDataFrame(
        [(1, "Coop Piim 1 kg", "a"), (2, "Piim 2 kg", "a"), (3, "Sai 500 g", "b"), (4, "Sai 500 g", "b"), (5, "Sai", None), (6, None, "a"), (7, "Juust", "a")], "id long, name string, sub_code string"
    )
    groups, members = C.build_groups(products)
    parsed = C.parsed_quantities(products, members, groups.withColumnRenamed("group_id", "id"))
    assert "regexp_replace" not in plan(parsed)  # canonical names and quantities were read eight times and twice
    want = [(1, 1, "SKIP_GROUP_CONFLICT"), (1, 2, "SKIP_GROUP_CONFLICT"), (3, 3, "WOULD_SET_SINGLE"), (3, 4, "WOULD_SET_SINGLE")]
    assert rows(parsed.select("group_id", "id", "status")) == want


def test_breaches_equal_a_count_of_what_came_in_time(spark, tmp_path):
    rng = random.Random(7)
    schema = "at timestamp, client string, endpoint string"
    batches, newest, counts, want = [], None, Counter(), []
    for b in range(4):
        batch = [(T0 + timedelta(seconds=b * 100 + rng.randint(-200, 100), microseconds=rng.randint(0, 999)), rng.choice(["a", "b", None]), rng.choice(["x", None])) for _ in range(60)]
        batch += [(None, "a", "x")]
        before = Counter(counts)
        for at, client, endpoint in batch:
            if at and (newest is None or at > newest - timedelta(seconds=120)):
                counts[int((at - datetime(1970, 1, 1)).total_seconds()) // 60 * 60, client, endpoint] += 1
        want.append(sorted((k for k, n in counts.items() if before[k] <= 4 < n), key=repr))
        newest = max([at for at, *_ in batch if at] + ([newest] if newest else []))
        newest = newest.replace(microsecond=newest.microsecond // 1000 * 1000)
        batches.append(batch)
    seen = []

    def build(stream):
        return J.breach_feed(stream, str(tmp_path / "out"), str(tmp_path / "state"), 60, 4)

    send(spark, tmp_path / "in", schema, batches, build)
    for folder in sorted((tmp_path / "out").glob("version=*")):
        seen.append(rows(spark.read.parquet(str(folder)).select(F.unix_seconds("window_start"), "client", "endpoint")))
    assert seen == want and sum(map(len, want)) > 5


def test_feeds_keep_no_state_a_key(spark, tmp_path):
    """A call to Python for each key and batch took hours on large tables."""
    progress = []
    requests = "at timestamp, client string, endpoint string"
    decisions = "k long, decided_at timestamp, expires_at timestamp"
    table = J.decision_table(spark, str(tmp_path / "current"), spark.createDataFrame([], decisions).schema, ["k"])
    for name, schema, data, build in (
        ("requests", requests, [(T0, "a", "x")], lambda s: J.breach_feed(s, str(tmp_path / "out"), str(tmp_path / "s1"))),
        ("decisions", decisions, [(1, T0, T0 + timedelta(days=1))], lambda s: J.decision_feed(s, table, str(tmp_path / "s2"))),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
        running = J.start(build(J.read_stream(spark, str(tmp_path / name), spark.createDataFrame([], schema).schema, None)), spark)
        running.awaitTermination()
        progress.append([p["stateOperators"] for p in running.recentProgress])
    assert all(not ops for batches in progress for ops in batches)


def test_a_batch_that_is_run_again_sees_the_table_before_it(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    table = ChangeTable(spark, str(tmp_path / "t"), schema, ["k"], [F.col("v").desc()])
    for batch in range(6):
        for _ in range(3):  # as after failures
            assert rows(table.read(before=batch)) == [(k, k) for k in range(batch)]
            table.append(spark.createDataFrame([(batch, batch)], schema), batch)
    assert rows(table.read()) == [(k, k) for k in range(6)]
