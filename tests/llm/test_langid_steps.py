"""The Viterbi pass over many sequences at once gives what a plain pass over each gives."""

import numpy as np

from lexspan.llm.langid import SWITCH, viterbi


def plain(emit):
    score, back = emit[0].copy(), []
    for e in emit[1:]:
        jump = score.max() - np.float32(SWITCH)
        back.append([int(score.argmax()) if s < jump else k for k, s in enumerate(score)])
        score = np.maximum(score, jump) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_steps_give_plain_paths():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(0, 15, rng.integers(1, 9))
        first = np.concatenate([[0], np.cumsum(sizes)])
        emit = rng.integers(-9, 10, (first[-1], 4)).astype(np.float32)
        want = [k for a, b in zip(first[:-1], first[1:]) if a < b for k in plain(emit[a:b])]
        assert viterbi(emit, first).tolist() == want
