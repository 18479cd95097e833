from pyspark.sql import functions as F

from millrace.functions import http
from millrace.operators import aggregate, groupstore, settle
from millrace.plans import edges
from millrace.sources import memory


def log(spark, rows):
    df = spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], "group_key string, n int, command string, message_id string, epoch_given long, at_us long")
    return [(r.result, r.members, r.epoch) for r in groupstore.replay(df, ["n"], 100).orderBy("n").collect()]


def test_claim_settles_only_what_it_saw(spark):
    got = log(spark, [("add", "a", None, 0), ("add", "a", None, 1), ("claim", None, None, 2), ("add", "b", None, 3), ("claim", None, None, 4), ("settle", None, 9, 5), ("settle", None, 1, 6), ("add", "a", None, 7), ("add", "", None, 8)])
    assert got == [("added", "a", 0), ("repeated", "a", 0), ("claimed", "a", 1), ("added", "a,b", 1), ("nothing", "a,b", 1), ("stale", "a,b", 1), ("settled", "b", 1), ("added", "b,a", 1), ("invalid", "b,a", 1)]


def test_leases_end_and_are_given_up(spark):
    got = log(spark, [("claim", None, None, 0), ("add", "a", None, 0), ("claim", None, None, 1), ("claim", None, None, 101), ("settle", None, 1, 102), ("abandon", None, 2, 103), ("settle", None, 2, 104), ("claim", None, None, 105), ("settle", None, 3, 106)])
    assert [r for r, _, _ in got] == ["nothing", "added", "claimed", "claimed", "stale", "abandoned", "stale", "claimed", "settled"]


def test_log_against_a_plain_replay(spark, sf_dir):
    rows = edges.group_store_log(spark, sf_dir).collect()
    state = {}
    for r in sorted(rows, key=lambda r: (r.group_key, r.at_us, r.event_id)):
        s = state.setdefault(r.group_key, {"live": [], "claimed": set(), "epoch": 0, "lock": None, "made": None})
        if r.command == "add":
            want = "repeated" if r.message_id in s["live"] else "added"
            if want == "added":
                s["live"].append(r.message_id)
                s["made"] = s["made"] if s["made"] is not None else r.at_us
        elif r.command == "claim":
            want = "nothing" if not s["live"] or s["lock"] is not None and r.at_us - s["lock"] < groupstore.LEASE_US else "claimed"
            if want == "claimed":
                s |= {"epoch": s["epoch"] + 1, "lock": r.at_us, "claimed": set(s["live"])}
        elif s["lock"] is None or r.epoch_given != s["epoch"]:
            want = "stale"
        elif r.command == "settle":
            s["live"] = [m for m in s["live"] if m not in s["claimed"]]
            s |= {"lock": None, "made": r.at_us if s["live"] else None}
            want = "settled"
        else:
            s["lock"], want = None, "abandoned"
        assert (r.result, r.members, r.epoch, r.created_us) == (want, ",".join(s["live"]), s["epoch"], s["made"])


def test_release_rules(spark):
    rows = [("g", i, {"p": str(i)}, (v,), 3) for i, v in enumerate([1, 5, 2, 9])]
    df = spark.createDataFrame(rows, "group_key string, at int, headers map<string,string>, payload struct<v:int>, sequence_size int")
    got = aggregate.by_release_expr(df, ["at"], 'len(messages) >= size && any(messages, {.payload.v > 4}) && messages[0].header("p") < 1')
    # the third member completes the group; the fourth begins one whose first header is 3
    assert [(r.batch, r.place, r.complete, r.err) for r in got.orderBy("at").collect()] == [(0, 1, False, False), (0, 2, False, False), (0, 3, True, False), (1, 1, False, False)]
    flat = df.select("group_key", "at", F.col("payload.v").alias("v"))
    got = aggregate.by_release(flat, ["at"], lambda live: sum(m["v"] for m in live) > 5).orderBy("at").collect()
    assert [(r.batch, r.place) for r in got] == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_memory_broker(spark):
    broker = memory.Broker()
    broker.send([(str(i), None, "p") for i in range(5)])
    assert broker.poll(spark, 2).count() == 2
    broker.nack("0")
    broker.nack("1", requeue=False)
    broker.ack("9")
    assert len(broker) == 4 and [r.message_id for r in broker.poll(spark).collect()] == ["2", "3", "4", "0"]


def test_outcomes_are_observed_and_texts_made_safe(spark):
    df = settle.settle(spark.range(3), F.when(F.col("id") == 1, "permanent"), F.lit(1), settle.RetryPolicy(settle.Backoff(1)))
    assert settle.observed(df, "outcomes").count() == 3
    row = spark.range(1).select(http.excerpt(F.lit('a"\n' + "x" * 300)).alias("e"), http.redact_url(F.lit("https://me:pw@h.example/p?q=1")).alias("u")).first()
    assert row.e.startswith('"a\\"\\nxxx') and len(row.e) == 260 and row.u == "https://h.example"
