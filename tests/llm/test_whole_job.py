"""Jobs that were once cut short, each on a table that shows the cut."""

from __future__ import annotations

import random
from collections import defaultdict
from math import log10

import pytest

from slatebed.llm import ppm, toxicity


def ppm_by_force(train: list[bytes], texts: list[bytes]) -> list[float]:
    """Method C with exclusion from plain dictionaries over every count."""
    start, end = bytes([ppm.START]) * ppm.ORDER, bytes([ppm.END])
    after: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for t in train:
        line = start + t + end
        for i in range(ppm.ORDER, len(line)):
            for k in range(ppm.ORDER + 1):
                after[line[i - k : i]][line[i]] += 1
    scores = []
    for t in texts:
        line, score = start + t + end, 0.0
        for i in range(ppm.ORDER, len(line)):
            gone: set[int] = set()
            for k in range(ppm.ORDER, -1, -1):
                left = {s: n for s, n in after.get(line[i - k : i], {}).items() if s not in gone}
                all_of = sum(left.values()) + len(left)
                if line[i] in left:
                    score += log10(left[line[i]] / all_of)
                    break
                if left:
                    score += log10(len(left) / all_of)
                gone |= set(left)
            else:
                score -= log10(ppm.SYMBOLS - len(gone))
        scores.append(score)
    return scores


def test_ppm_keeps_every_count(spark):
    rng = random.Random(3)
    common = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    train = [common] * 5200 + ["one rare sentence, seen once", "Ünï 😀", ""]  # beyond 2^20 bytes
    texts = ["one rare sentence, seen once more", common[:90], "qqq zzz", "", "Ünï"]
    got = ppm.score_texts(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(t,) for t in train], "text string")
    ).collect()
    assert sum(map(len, train)) > 2**20
    weighed = ppm_by_force([t.lower().encode() if t.isascii() else t.encode() for t in train[-3:]] + [common.encode()] * 5200, [t.encode().translate(ppm._LOWER) for t in texts])
    # the only capital letter of the training texts is not ASCII and stays
    assert [r.score for r in sorted(got)] == pytest.approx(weighed, rel=1e-9)


def test_crf_learns_from_every_piece():
    rng = random.Random(4)
    clean = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    toxic = [" ".join(["vilewords"] * 2 + list("abc")) for _ in range(60)]
    texts, label = clean + toxic, [0] * 300 + [1] * 60
    one = toxicity.fit(texts, label)
    other = toxicity.fit(texts[7:] + texts[:7], label[7:] + label[:7])  # pieces in another order
    assert other.bias == pytest.approx(one.bias, rel=1e-9) and other.moves == pytest.approx(one.moves, rel=1e-9)
