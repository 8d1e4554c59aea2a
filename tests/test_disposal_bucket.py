"""One call of the keyed disposal gate serves a whole bucket of instances."""

import pandas as pd

from tracewise.streaming.disposal import DisposalGate


class State:
    value, writes = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1


def gate():
    g = DisposalGate()
    g.sold = State()
    return g


def run(g, *events):
    parts = [pd.DataFrame(events[k:k + 2], columns=["EventID", "InstanceID", "EventType"]) for k in range(0, len(events), 2)]
    return dict(zip(*(pd.concat(list(g.handleInputRows((7,), iter(parts), None)))[c] for c in ("EventID", "status")), strict=True))


def test_instances_of_a_bucket_are_told_apart():
    big = (1 << 53) + 1
    g = gate()
    assert run(g, (1, 5, "Sold"), (2, 5, "disposed"), (3, big, "Disposed"), (4, big - 1, "SOLD"), (5, big - 1, "Disposed"), (6, 9, "Repair")) == {
        1: "accepted", 2: "accepted", 3: "rejected", 4: "accepted", 5: "accepted", 6: "accepted"}
    assert g.sold.writes == 1
    # the next micro-batch finds the sales again; nothing new is not written; an earlier sale is
    assert run(g, (7, 5, "Disposed"), (8, 9, "Disposed"), (9, 5, "Sold"), (10, big, None)) == {7: "accepted", 8: "rejected", 9: "accepted", 10: "accepted"}
    assert g.sold.writes == 1
    assert run(g, (0, 5, "Sold"), (11, big, "Sold"), (12, big, "Disposed")) == {0: "accepted", 11: "accepted", 12: "accepted"}
    assert g.sold.writes == 2


def test_rows_without_instance_match_no_sale():
    g = gate()
    assert run(g, (1, None, "Disposed"), (2, None, "Sold"), (3, None, "Disposed"), (4, None, "Repair")) == {
        1: "rejected", 2: "accepted", 3: "rejected", 4: "accepted"}
    assert g.sold.writes == 0
