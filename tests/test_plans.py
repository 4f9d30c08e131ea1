import pytest
from docquarry.plans import client, dashboard, settings
from pyspark.sql import functions as F

from .test_operators import ITEMS, KINDS


def test_clients_speak_both_protocols():
    sent = []

    def send(url, body, key, timeout):
        sent.append((url, body, key, timeout))
        if url.endswith("/api/tags"):
            return {"models": [{"name": "m"}]}
        if url.endswith("/models"):
            return {"data": [{"id": "n"}]}
        return {"message": {"content": "a"}} if "/api/" in url else {"choices": [{"message": {"content": "b"}}]}

    base = settings.typed({"llm_base_url": "http://h/", "llm_model": "m"})
    one = client.Client(base, send)
    assert one.test() == {"ok": True, "models": ["m"], "message": "model found"} and one("s", "u") == "a"
    two = client.Client(base | {"llm_provider": "openai", "llm_api_key": "k"}, send)
    assert two.models() == ["n"] and two("s", "u") == "b" and sent[-1][0] == "http://h/v1/chat/completions" and sent[-1][2] == "k"

    def fails(*_):
        raise RuntimeError("no server")

    assert client.Client(base, fails).test()["ok"] is False


def test_dashboard(spark):
    items = spark.createDataFrame(ITEMS, KINDS)
    roots = spark.createDataFrame([(1, "r", "l", 1, 5), (2, "empty", "l", 1, 6)], "root_id bigint, root_path string, label string, is_enabled int, created_ts bigint")
    jobs = spark.createDataFrame([(1, 1, "running", 5), (2, 9, "done", 6), (3, 9, "pending", 7)], "job_id int, root_id bigint, status string, started_ts int")
    members = spark.createDataFrame([("g", 1), ("g", 2)], "group_key string, item_id int")
    errors = spark.createDataFrame([("/x",), ("/x",)], "full_path string")
    got = {k: v.collect() for k, v in dashboard.dashboard(items, members, errors, jobs, roots).items()}
    assert tuple(got["totals"][0]) == (3, 10) and got["errors"][0].errors == 1 and len(got["insights"]) == 2
    assert [(r.job_id, r.root_path) for r in got["active_jobs"]] == [(3, None), (1, "r")]
    assert [(r.root, r.item_count) for r in got["roots"]] == [("empty", 0), ("r", 2)]
    assert [r.job_id for r in dashboard.resumable_jobs(jobs).collect()] == [1, 3]
    more = dashboard.add_root(dashboard.add_root(roots, "new", "x", 9), "new", "y", 10)
    assert more.count() == 3 and more.where("root_path = 'new'").first().label == "x"
    assert dashboard.set_enabled(roots, 1, False).where(F.col("is_enabled") == 0).count() == 1


def test_arguments_out_of_range(spark):
    from docquarry.operators import listing, timeline
    from docquarry.sources import files as src

    items = spark.createDataFrame([(1, "image", 0, 5, 5)], "item_id int, file_type_group string, is_deleted int, best_time_ts bigint, modified_ts bigint")
    meta = spark.createDataFrame([], "item_id int, taken_ts bigint, title string, camera_model string, meta_json string")
    for call in (lambda: timeline.bucket(F.lit(1), "week"), lambda: src.thumbnail_key(F.lit(1), F.lit("t"), 63), lambda: src.thumbnail_key(F.lit(1), F.lit("t"), 1025), lambda: src.text_page(F.lit("x"), 499), lambda: listing.list_images(items, meta, limit=301)):
        with pytest.raises(ValueError):
            call()
    assert listing.list_images(items, meta, limit=300).count() == 1


def test_policies_of_content_and_metadata(spark, tmp_path):
    """A text's language stays once it is known; all of the metadata is that of the last reading."""
    from docquarry.streaming.store import Store

    schema = "full_path string, text string, content_language string, title string, width int"
    store = Store(spark, f"file://{tmp_path}/s")
    for row in (("/a", "one", None, "t", 5), ("/a", "two", "en", None, 6), ("/a", "three", "de", "u", None)):
        store.put(spark.createDataFrame([row], schema))
    assert tuple(store.current().first()) == ("/a", "three", "en", "u", None)
