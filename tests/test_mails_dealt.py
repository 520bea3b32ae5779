"""Messages are read by as many tasks as a shuffle has, however small the table they are made of."""

from quoteflow.operators import messages
from quoteflow.plans.base import Inputs


def test_raw_messages_lie_in_many_tasks(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = t.mails.select("message_id", "raw_text")
    assert messages.parse_raw_messages(raw).rdd.getNumPartitions() == tasks
    assert raw.count() == t.orders.count()
