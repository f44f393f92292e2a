from types import SimpleNamespace

from tessera.sources import publish
from tessera.streaming import Follower


def test_follower_keeps_what_works(spark, monkeypatch):
    names, loads = ["g1"], []
    monkeypatch.setattr("tessera.streaming.current", lambda root: names[-1])

    def load(spark, root):
        loads.append(names[-1])
        if names[-1] == "bad":
            raise ValueError("counts")
        return SimpleNamespace(name=names[-1], degraded=[])

    f = Follower(None, "r", load)
    assert f.get().name == "g1" and f.get().name == "g1" and loads == ["g1"]
    names.append("bad")
    assert f.get().name == "g1" and f.get().degraded == ["reload_rejected"] and loads == ["g1", "bad"]
    names.append("g2")
    assert f.get().name == "g2" and f.rejected is None
    assert publish.current("/nowhere") is None
