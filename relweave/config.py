"""Parameters of a bootstrap run, from defaults, a key=value file and the command line."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from relweave.sources import files


@dataclass(frozen=True)
class Config:
    """Defaults are those of the method; a file and keyword arguments override them.

    update_weight is accepted and has no effect.
    """

    context_window_size: int = 2
    min_tokens_away: int = 1
    max_tokens_away: int = 6
    similarity: float = 0.6
    confidence: float = 0.6
    alpha: float = 0.0
    beta: float = 1.0
    gamma: float = 0.0
    min_pattern_support: int = 4
    negative_weight: float = 2.0
    unknown_weight: float = 0.0
    update_weight: float = 0.5
    iterations: int = 2
    e1_type: str = "ORG"
    e2_type: str = "LOC"
    word2vec_path: str = ""

    def __post_init__(self) -> None:
        if abs(self.alpha + self.beta + self.gamma - 1) > 1e-9:
            raise ValueError("alpha + beta + gamma must be 1")
        if min(self.alpha, self.beta, self.gamma) < 0:
            raise ValueError("weights must not be negative")
        if self.similarity <= 0:
            raise ValueError("the similarity threshold must be above 0")
        if self.min_tokens_away > self.max_tokens_away:
            raise ValueError("min_tokens_away is above max_tokens_away")

    def report(self) -> str:
        """The parameters, one a line."""
        return "\n".join(f"{f.name:20}: {getattr(self, f.name)}" for f in fields(self))


# Keys of a parameter file whose names differ from the fields.
KEYS = {"wUpdt": "update_weight", "wUnk": "unknown_weight", "wNeg": "negative_weight"}


def parse_config(text: str, **given) -> Config:
    """Config of a parameter file's text: key=value lines; blank lines and what follows # are left out. given overrides it.

    Keys that are not in the file keep their defaults; unknown keys are an error.
    """
    kinds = {f.name: f.type for f in fields(Config)}
    cast = {"int": int, "float": float, "str": str}
    found = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, sep, value = (x.strip() for x in line.partition("="))
        name = KEYS.get(key, key)
        if not sep or name not in kinds:
            raise ValueError(f"not a parameter: {line}")
        found[name] = cast[kinds[name]](value)
    return replace(Config(), **{**found, **{k: v for k, v in given.items() if v is not None}})


def load_config(path: str | None, **given) -> Config:
    """parse_config of a file; defaults without one."""
    if path is None:
        return parse_config("", **given)
    return parse_config(files.read_bytes(path).decode("utf-8"), **given)
