"""Session files below several roots, optional texts, and runs of an evaluator."""

import json
import os

from factloom.api import Engine
from factloom.operators import evaluator
from factloom.sources import journal, sessions


def put(path, text='{"type":"session","id":"%s","cwd":"/w"}\n{"x":1}\n'):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text % path.stem if "%s" in text else text)


def test_session_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    put(a / "top.jsonl")
    put(a / "1/2/3/4/5/deep.jsonl")
    put(a / "1/2/3/4/5/6/too_deep.jsonl")
    put(a / ".hidden/no.jsonl")
    put(a / "1/.hidden/no.jsonl")
    put(a / ".dotted.jsonl")
    put(a / "other.txt")
    put(a / "bad.jsonl", "nothing\n")
    put(a / "late.jsonl", " " * 140_000 + '{"type":"session","id":"late"}')
    put(a / "number.jsonl", '{"type":"session","id":5}')
    put(a / "list.jsonl", "[1]\n")
    put(b / "x" / "one.jsonl", '  {"type":"session","id":"one","parentSession":"top","cwd":7}  ')
    os.symlink(a, b / "link")
    files = sessions.session_files(spark, str(a), str(b), str(a / "1"), str(tmp_path / "missing"))
    names = sorted(os.path.basename(r.path) for r in files.collect())
    assert names == [".dotted.jsonl", "bad.jsonl", "deep.jsonl", "late.jsonl", "list.jsonl", "number.jsonl", "one.jsonl", "too_deep.jsonl", "top.jsonl"]
    found = {r.id: (r.cwd, r.parent) for r in Engine(spark).sessions(str(a), str(b), f"file://{a}").collect()}
    assert found == {".dotted": ("/w", None), "deep": ("/w", None), "top": ("/w", None), "one": (None, "top")}
    assert sessions.session_files(spark, str(tmp_path / "missing")).count() == sessions.session_files(spark).count() == 0


def test_the_first_files_of_a_root_are_taken(spark, tmp_path):
    for k in range(30):
        put(tmp_path / f"f{k % 3}" / f"s{k:02}.jsonl")
    put(tmp_path / "e.jsonl")
    put(tmp_path / "z.jsonl")
    got = sorted(os.path.relpath(r.path, tmp_path) for r in sessions.session_files(spark, str(tmp_path), limit=13).collect())
    assert got == sorted(["e.jsonl", *(f"f0/s{k:02}.jsonl" for k in range(0, 30, 3)), "f1/s01.jsonl", "f1/s04.jsonl"])


def test_optional_text(spark, tmp_path):
    put(tmp_path / "there.txt", "said")
    got = journal.optional_text(spark, [str(tmp_path / "there.txt"), str(tmp_path / "not.txt")], 100).collect()
    assert [(r.text, r.truncated, r.source_chars) for r in got] == [("said", False, 4)]
    assert journal.optional_text(spark, [str(tmp_path / "not.txt")], 100).count() == 0


def model_in(folder, fail_on=None):
    """A stub that leaves a mark for every call; it fails once on one prompt."""

    def model(messages):
        prompt = messages[0]
        with open(f"{folder}/calls", "a") as f:
            f.write(json.dumps([prompt, len(messages)]) + "\n")
        if prompt == fail_on and not os.path.exists(f"{folder}/failed"):
            open(f"{folder}/failed", "w").close()
            raise RuntimeError("model is away")
        if prompt.startswith("never") or prompt.startswith("later") and len(messages) == 1:
            return "sorry,  no\nJSON"
        return '```json\n{"b":2,"a":1}\n```' if prompt.startswith("fenced") else '{"a":1}'

    return model


def calls(folder):
    with open(f"{folder}/calls") as f:
        return sorted(tuple(json.loads(line)) for line in f)


def test_outcomes_are_kept_and_calls_not_repeated(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "bare"), (2, "fenced"), (3, "later"), (4, "never"), (5, None), (6, "bare"), (7, "")], "k int, prompt string")
    model = model_in(str(tmp_path))
    run = lambda rows: {r.k: (r.n_calls, r.recovered, r.evaluation, r.problem) for r in evaluator.outcomes(rows, model, str(tmp_path / "kept")).collect()}
    want = {1: (1, False, '{"a":1}', None), 2: (1, False, '{"a":1,"b":2}', None), 3: (2, True, '{"a":1}', None), 4: (2, False, None, "no JSON object; answer: sorry, no JSON"), 5: (None,) * 4, 6: (1, False, '{"a":1}', None), 7: (1, False, '{"a":1}', None)}
    assert run(prompts) == want
    before = calls(tmp_path)
    assert before == [("", 1), ("bare", 1), ("fenced", 1), ("later", 1), ("later", 3), ("never", 1), ("never", 3)]
    more = prompts.unionByName(spark.createDataFrame([(8, "bare two")], "k int, prompt string"))
    assert run(more) == want | {8: (1, False, '{"a":1}', None)}
    assert calls(tmp_path) == sorted([*before, ("bare two", 1)])
    assert run(prompts.limit(0)) == {}


def test_windows_before_a_failed_call_are_not_asked_again(spark, tmp_path):
    prompts = spark.range(40).selectExpr("cast(id as string) prompt")
    run = lambda: evaluator.outcomes(prompts, model_in(str(tmp_path), "7"), str(tmp_path / "kept"), window=4, at_once=1)
    try:
        assert run().count() == 40  # a scheduler that tries tasks again comes through at once
    except Exception as problem:
        assert "model is away" in str(problem)
        assert run().count() == 40
    made = calls(tmp_path)
    assert len({p for p, _ in made}) == 40 and 40 < len(made) <= 44
