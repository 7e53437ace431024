"""Python workers give memory back between tasks."""

from palimpsest.llm import common


def test_memory_is_released_after_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    run = common._released(lambda batches: (x + 1 for x in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and calls == [1]
    left = run(iter([1, 2]))
    next(left)
    left.close()  # a task that ends early
    assert calls == [1, 1]
    monkeypatch.undo()
    common.release_memory()
