"""long words at the start, a sentence end behind them: the passages still come to an end."""

from __future__ import annotations

import signal

from lodestar.operators.passages import passages


def test_an_early_sentence_end_splits_none():
    words = [f"{i:0100d}" for i in range(20)] + ["end."] + [f"w{i}" for i in range(600)]
    signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError("no end")))
    signal.alarm(5)
    try:
        found = passages(" ".join(words))
    finally:
        signal.alarm(0)
    assert found[0][1].split() == words[:250] and found[1][1].split()[:30] == words[220:250]
    assert set(" ".join(t for _, t in found).split()) == set(words)
