import random

import pytest
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.plans import views
from usagelens.plans.jobs import Store
from usagelens.plans.view_states import ViewStates

CHATS = ("chat_id string, conversation_key string, provider string, model_name string, conversation_title string, author string, "
         "conversation_timestamp string, user_text_clean string")


def tables(spark, n=120):
    """Messages of few conversations with nulls in every column, and findings of some of them."""
    rng = random.Random(5)
    some = lambda values: rng.choice([*values, None])
    chats = [(str(i), some(["c1", "c2", "c3"]), some(["p", "q"]), some(["m", "n"]), some(["t"]), some(["user"]),
              some(["2024-01-01 10:00:00", "2024-01-02 23:59:59"]), some(["", "text", "é" * 9])) for i in range(n)]
    chats.append((None, "c9", "z", None, None, None, None, None))
    found = [(f"f{i}", str(rng.randrange(n + 20)), some(["secrets", "llm_complexity"]), some(["security_leak", "content_leak", "usage_quality"]),
              some(["critical", "high", "low"]), "2024-02-01 00:00:00" if i % 2 else f"2024-02-0{i % 9 + 1} 00:00:00",
              some(['{"complexity_score": 3.5}', "{}", "no json"])) for i in range(3 * n)]
    risks = [(str(i), rng.randrange(100)) for i in range(0, n, 3)]
    chats = spark.createDataFrame(chats, CHATS).withColumn("conversation_timestamp", F.col("conversation_timestamp").cast("timestamp"))
    found = spark.createDataFrame(found, "finding_id string, chat_id string, analyzer string, category string, severity string, created_at string, meta string")
    have = {"finding_id", "chat_id", "analyzer", "category", "severity", "created_at"}
    kinds = [f.split(" ") for f in schemas.FINDINGS.split(", ")]
    found = found.select(*[(F.col(n) if n in have else F.lit(None)).cast(k).alias(n) for n, k in kinds], "meta")
    return chats, found, spark.createDataFrame(risks, "chat_id string, risk_score int")


def same(states, chats, found, risks):
    # A rebuild chooses its newest findings before it looks for their messages; stored findings all have theirs.
    want = views.detector_views(chats, found.join(chats, "chat_id", "left_semi"), risks)
    got = states.views()
    assert got.keys() == want.keys()
    for name, frame in want.items():
        assert sorted(map(str, got[name].select(*frame.columns).collect())) == sorted(map(str, frame.collect())), name


def test_batches_give_what_a_rebuild_gives(spark, tmp_path):
    chats, found, risks = (t.cache() for t in tables(spark))
    states = ViewStates(Store(spark, str(tmp_path / "store"), 4))
    number = F.coalesce(F.col("chat_id").cast("int"), F.lit(0))
    states.add(0, chats.filter(number < 50), found, risks)
    same(states, chats.filter(number < 50), found, risks)
    second = chats.filter((number >= 30) & (number < 90))  # repeats some of the first
    states.add(1, second, found, risks)
    states.add(1, second, found, risks)
    states.compact()
    states.add(1, second, found, risks)  # the newest batch may come again after it was added up, too
    states.add(2, chats, found, risks)
    same(states, chats, found, risks)
    states.compact()
    same(states, chats, found, risks)


def test_empty_and_a_lost_writer(spark, tmp_path, monkeypatch):
    chats, found, risks = tables(spark, 20)
    states = ViewStates(Store(spark, str(tmp_path / "store"), 4))
    states.add(0, chats.limit(0), found, risks)
    same(states, chats.limit(0), found, risks)

    def lost(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(states.categories, "upsert", lost)  # ids and the first states are stored, the others are not
        with pytest.raises(RuntimeError):
            states.add(1, chats, found, risks)
    states.add(1, chats, found, risks)
    same(states, chats, found, risks)
