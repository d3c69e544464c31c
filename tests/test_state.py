"""Stateful resume: a stream that is stopped, repeated and gone on with tells the same rows once."""

import json

from ablatrix.streaming import state


def attempt(task, n, status="complete", payload="p"):
    return {"task": task, "attempt": n, "status": status, "payload_sha256": payload if status == "complete" else None}


def test_stopped_and_repeated_stream(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()

    def put(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def go():
        state.follow(spark, source, target, checkpoint).awaitTermination(120)
        return {r.task: (r.attempts, r.last_attempt, r.done, r.payload_sha256, r.conflict) for r in state.known_tasks(spark, target).collect()}

    put("1.jsonl", attempt("a", 0, "error"), attempt("a", 1), attempt("b", 0, "error"), attempt("c", 0))
    first = go()
    assert first == {"a": (2, 1, True, "p", False), "b": (1, 0, False, None, False), "c": (1, 0, True, "p", False)}
    assert go() == first  # nothing new
    put("2.jsonl", attempt("b", 0, "error"), attempt("b", 1, "error"), attempt("a", 1), attempt("d", 0, "error"))  # two seen attempts come again
    second = go()
    assert second == first | {"b": (2, 1, False, None, False), "d": (1, 0, False, None, False)}
    batches = sorted(p.name for p in (tmp_path / "out").glob("batch=*"))
    for kept in (tmp_path / "cp" / "commits").glob("*"):  # as if the driver had been lost before the batch's commit was noted
        if kept.name.lstrip(".").split(".")[0] == "1":
            kept.unlink()
    assert go() == second and sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == batches
    put("3.jsonl", attempt("c", 1, payload="other"), attempt("b", 2))
    third = go()
    assert third == second | {"c": (2, 1, True, "p", True), "b": (3, 2, True, "p", False)}
    plan = spark.createDataFrame([(t,) for t in "abcdx"], "id string")
    rest = {(r.id, r.attempts, r.conflict) for r in state.unfinished(plan, state.known_tasks(spark, target)).collect()}
    assert rest == {("c", 2, True), ("d", 1, False), ("x", 0, False)}
