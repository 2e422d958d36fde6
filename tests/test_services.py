import json
import os
from pathlib import Path

import pytest

from tidewright.sources import services


@pytest.fixture
def folder(spark, tmp_path):
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("flaky.py")))
    (tmp_path / "asked").mkdir()
    return tmp_path


def asked(folder):
    return {p.name: p.stat().st_size for p in (folder / "asked").iterdir()}


def test_a_call_is_made_as_often_as_stated(spark, folder):
    services.register(spark)
    names = ["fine", "slow_2", "lost_2", "busy_1", "limit_2", "slow_9", "wrong_1", "text_1"]
    options = {"url": "x", "calls": json.dumps({n: {"q": n} for n in names}), "fields": json.dumps({"folder": str(folder / "asked")}), "transport": "flaky:flaky", "tries": "3", "wait": "0.01"}
    rows = {r.name: (r.answer is not None, r.error, r.tries) for r in spark.read.format("json_service").options(**options).load().collect()}
    assert rows == {
        "fine": (True, None, 1), "slow_2": (True, None, 3), "lost_2": (True, None, 3), "busy_1": (True, None, 2), "limit_2": (True, None, 3),
        "slow_9": (False, "timeout", 3), "wrong_1": (False, "status 401", 1), "text_1": (False, "not JSON", 1),
    }
    assert asked(folder) == {n: t for n, (_, _, t) in rows.items()}


def test_waits_double_and_end():
    waits, answers = [], iter([(None, "timeout", True)] * 5)
    assert services.tried(lambda: next(answers), 4, 0.5, waits.append) == (None, "timeout", 4) and waits == [0.5, 1.0, 2.0]
    assert services.tried(lambda: (None, "status 400", False), 4, 1, waits.append) == (None, "status 400", 1)
    assert services.tried(lambda: ("{}", None, False), 0, 1, waits.append) == ("{}", None, 1) and len(waits) == 3


def test_a_rerun_asks_for_what_failed(spark, folder):
    kept, options = str(folder / "kept"), {"fields": json.dumps({"folder": str(folder / "asked"), "key": "secret"}), "transport": "flaky:flaky", "tries": "1"}
    calls = {n: {"q": n} for n in ("fine", "slow_1", "wrong_2")} | {"again": {"q": "fine"}}
    run = lambda calls: {r.name: (r.error, r.tries) for r in services.resumed(spark, kept, "x", calls, **options).collect()}
    assert run(calls) == {"fine": (None, 1), "again": (None, 1), "slow_1": ("timeout", 1), "wrong_2": ("status 401", 1)}
    assert asked(folder) == {"fine": 1, "slow_1": 1, "wrong_2": 1}
    assert run(calls) == {"fine": (None, 0), "again": (None, 0), "slow_1": (None, 1), "wrong_2": ("status 401", 1)}
    assert run(calls | {"new": {"q": "other"}}) == {"fine": (None, 0), "again": (None, 0), "slow_1": (None, 0), "wrong_2": (None, 1), "new": (None, 1)}
    assert run(calls) == {n: (None, 0) for n in calls}
    assert asked(folder) == {"fine": 1, "slow_1": 2, "wrong_2": 3, "other": 1}
    assert "secret" not in "".join(services.request_key("x", c) for c in calls.values()) and os.path.isdir(kept)
    answers = services.resumed(spark, kept, "x", {"fine": {"q": "fine"}}, **options).collect()
    assert [json.loads(r.answer) for r in answers] == [{"data": []}]
