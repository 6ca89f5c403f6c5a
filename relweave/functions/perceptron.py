"""A part-of-speech tagger trained from tagged sentences: an averaged perceptron over a word, its ending, and its neighbours.

The weights are a JSON file that any tagged corpus can be made into, with this module or another program: words (word: tag, for words that have
one tag all but always), tags, and weights (feature: tag: weight). Features are named by what they hold, see _features.
"""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache

from relweave.sources import files

Tagged = list[tuple[str, str]]
#: A word gets its tag from the table if it was seen so often, and with the tag in at least this share.
SEEN, SURE = 20, 0.97


def _shape(w: str) -> str:
    if w.isdigit():
        return "!digits"
    if any(c.isdigit() for c in w):
        return "!number"
    if "-" in w[1:-1]:
        return "!hyphen"
    return w.lower()


def _features(words: list[str], i: int, before: str, before2: str) -> list[str]:
    """What speaks for a tag: the word, its ending and first letter, the tags given to the two words before, and the words around."""
    at = lambda k: _shape(words[k]) if 0 <= k < len(words) else "!edge"
    w, left, right = at(i), at(i - 1), at(i + 1)
    return [
        "bias", f"word={w}", f"end={w[-3:]}", f"end2={w[-2:]}", f"first={w[:1]}", f"upper={words[i][:1].isupper() and i > 0}", f"tag-1={before}", f"tag-2={before2}", f"tags={before2},{before}",
        f"tag-1,word={before},{w}", f"left={left}", f"leftend={left[-3:]}", f"left2={at(i - 2)}", f"right={right}", f"rightend={right[-3:]}", f"right2={at(i + 2)}",
    ]


class Model:
    """Weights and the words with one tag."""

    def __init__(self, words: dict[str, str], tags: list[str], weights: dict[str, dict[str, float]]):
        self.words, self.tags, self.weights = words, tags, weights

    def best(self, features: list[str]) -> str:
        """The tag with the highest sum of weights; of equal ones the last by name."""
        score: dict[str, float] = defaultdict(float)
        for f in features:
            for tag, w in self.weights.get(f, {}).items():
                score[tag] += w
        return max(self.tags, key=lambda t: (score.get(t, 0.0), t))

    def __call__(self, words: list[str]) -> list[str]:
        """The tags of one sentence's tokens."""
        out: list[str] = []
        for i, w in enumerate(words):
            tag = self.words.get(_shape(w)) or self.best(_features(words, i, out[-1] if out else "!edge", out[-2] if len(out) > 1 else "!edge"))
            out.append(tag)
        return out

    def save(self, path: str) -> None:
        """Writes the JSON file."""
        files.write_bytes(path, json.dumps({"words": self.words, "tags": self.tags, "weights": self.weights}, ensure_ascii=False).encode())


def train(sentences: Iterable[Tagged], rounds: int = 5, most: int = 200_000, seed: int = 1) -> Model:
    """A model of tagged sentences, of which the first most are used (a bounded sample; they are held in memory)."""
    held = [s for _, s in zip(range(most), sentences) if s]
    seen: dict[str, Counter] = defaultdict(Counter)
    for s in held:
        for w, t in s:
            seen[_shape(w)][t] += 1
    sure = {w: c.most_common(1)[0][0] for w, c in seen.items() if sum(c.values()) >= SEEN and c.most_common(1)[0][1] >= SURE * sum(c.values())}
    tags = sorted({t for c in seen.values() for t in c})
    model = Model(sure, tags, {})
    weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    total: dict[tuple[str, str], float] = defaultdict(float)
    since: dict[tuple[str, str], int] = defaultdict(int)
    model.weights, step, rng = weights, 0, random.Random(seed)

    def move(f: str, tag: str, by: float) -> None:
        key = (f, tag)
        total[key] += (step - since[key]) * weights[f][tag]
        since[key] = step
        weights[f][tag] += by

    for _ in range(rounds):
        rng.shuffle(held)
        for s in held:
            words, before, before2 = [w for w, _ in s], "!edge", "!edge"
            for i, (w, t) in enumerate(s):
                got = sure.get(_shape(w))
                if got is None:
                    features = _features(words, i, before, before2)
                    got, step = model.best(features), step + 1
                    if got != t:
                        for f in features:
                            move(f, t, 1.0)
                            move(f, got, -1.0)
                before, before2 = got, before
    # the mean of a weight over all steps forgets the last sentences' swing
    mean: dict[str, dict[str, float]] = {}
    for f, by_tag in weights.items():
        for tag, w in by_tag.items():
            value = round((total[f, tag] + (step - since[f, tag]) * w) / max(step, 1), 5)
            if value:
                mean.setdefault(f, {})[tag] = value
    return Model(sure, tags, mean)


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    """The model of a file, once a process."""
    d = json.loads(files.read_bytes(path))
    return Model(d["words"], d["tags"], d["weights"])


def tagger(path: str) -> Callable[[list[str]], list[str]]:
    """A tagger for functions.tagging.pos_tags: executors read the file, which all of them must reach, when they first need it."""
    return lambda words: load(path)(words)
