import os

import pytest

from tessera.plans.actions import LockHeld, RepoState, decide, in_grace, open_permissions, orphans, transaction


def test_decisions():
    base = {"recorded_code": "c", "recorded_semantic": "s", "code": "c", "semantic": "s", "recorded_recipe": 3}
    assert decide(RepoState(has_graph=False)) == "bootstrap" and decide(RepoState()) == "update"
    assert decide(RepoState(**base)) == "skip"
    assert decide(RepoState(**{**base, "code": "d"})) == "update" and decide(RepoState(**base, drift=True)) == "update"
    assert decide(RepoState(**{**base, "semantic": "t"})) == "extract"
    assert decide(RepoState(**{**base, "semantic": "t"}, refused="t")) == "skip"
    assert decide(RepoState(**{**base, "semantic": "t"}, refused="t", granted=True)) == "extract"
    assert decide(RepoState(**{**base, "semantic": "t"}, ast_only=True)) == "update"
    assert decide(RepoState(**{**base, "recorded_recipe": 2})) == "update"


def test_lock_and_ops(tmp_path):
    p = str(tmp_path / "lock")
    with transaction(p), pytest.raises(LockHeld), transaction(p):
        pass
    with transaction(p):
        pass
    assert in_grace(0.0, 3600.0, 2) and not in_grace(0.0, 7200.0, 2) and not in_grace(None, 0, 2)
    os.chmod(p, 0o644)
    assert open_permissions([p, "/nowhere"]) == [p]
    assert orphans("PID PPID CMD\n10 1 serve a\n11 10 serve b\n12 99 serve c\n13 99 other", ["serve"]) == [10, 12]
