"""What the stateful intake costs a digest: one look at its state, a change only where there is one, and no frame."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from recordloom.streaming.stateful import Holders


class Held:
    """A value of a state store that counts its calls."""

    def __init__(self, value=None):
        self.value, self.calls = value, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def rows(*given):
    return iter([Row(full_path=p, size_bytes=1, at=at, low=None if p is None else p.lower(), sha256="d", slot="d", other=other, known=None) for p, at, other in given])


@pytest.mark.parametrize(
    ("held", "given", "want", "calls", "kept"),
    [
        (None, [("/b", 5, None), ("/a", 5, None), ("/c", 9, "/x")], {"/a": False, "/b": True, "/c": True}, ["get", "update"], ("/b", "/a")),
        (("/a", None), [("/a", 1, None)], {"/a": False}, ["get"], ("/a", None)),
        (("/a", "/b"), [("/c", 1, None), (None, 1, None)], {"/c": True, None: True}, ["get"], ("/a", "/b")),
        (None, [(None, 1, None), ("/z", 1, None)], {"/z": False, None: True}, ["get", "update"], ("/z", None)),
    ],
)
def test_a_digest_costs_one_look_at_its_state(held, given, want, calls, kept):
    state = Held(held)
    holders = Holders(None)
    holders.init(SimpleNamespace(getValueState=lambda *_: state))
    got = {r.full_path: r.is_duplicate for r in holders.handleInputRows(("d",), rows(*given), None)}
    assert (got, state.calls, state.value) == (want, calls, kept)
    timed = Holders(1000)
    timed.init(SimpleNamespace(getValueState=lambda *_: state))
    list(timed.handleInputRows(("d",), rows(("/a", 1, None)), None))
    assert state.calls[-1] == "update"  # a time to live begins anew
