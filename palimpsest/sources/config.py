"""Settings: defaults, then a YAML file, then the environment or Spark's conf, then arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession

from ..functions import fixed as X

ENV, CONF = "PALIMPSEST_", "spark.palimpsest."
# Words for yes and no.
YES, NO = ("1", "true", "yes", "on", "y", "t"), ("0", "false", "no", "off", "n", "f", "")


@dataclass(frozen=True)
class Settings:
    language: str = X.DEFAULTS["language"]
    parser: str = X.DEFAULTS["parser"]
    model_name: str = X.DEFAULTS["model_name"]
    model_revision: str | None = None
    ner_disabled: bool = False
    device: str | None = None
    ner_max_length: int = X.DEFAULTS["ner_max_length"]
    ner_stride: int = X.DEFAULTS["ner_stride"]
    ner_score: float = X.DEFAULTS["ner_score"]
    mask_char: str = X.DEFAULTS["mask_char"]
    mask_count: int = X.DEFAULTS["mask_count"]
    mask_from_end: bool = False
    translit: bool = True
    english_numbers: bool = True
    base64: bool = True
    foreign_threshold: float = X.DEFAULTS["foreign_threshold"]
    max_text_chars: int = X.DEFAULTS["max_text_chars"]
    max_texts: int = X.DEFAULTS["max_texts"]
    entities: tuple[str, ...] = field(default_factory=lambda: tuple(X.ENTITIES))


def coerce(name: str, value):
    """A value of the setting's type. No list of entities is the default list, never nothing."""
    kind = {f.name: f.type for f in fields(Settings)}.get(name)
    if kind is None:
        raise ValueError(f"unknown setting {name!r}")
    if name == "entities":
        parts = value.split(",") if isinstance(value, str) else list(value or ())
        names = tuple(dict.fromkeys(p.strip().upper() for p in parts if p.strip()))
        return names or tuple(X.ENTITIES)
    if kind == "bool":
        if isinstance(value, bool):
            return value
        word = str(value).strip().lower()
        if word not in YES + NO:
            raise ValueError(f"{name}: {value!r} is neither yes nor no")
        return word in YES
    if kind in ("int", "float"):
        return (int if kind == "int" else float)(value)
    text = None if value is None else str(value).strip()
    return (text or None) if kind == "str | None" else (text or "")


def load(path: str | None = None, spark: SparkSession | None = None, env: dict[str, str] | None = None, **overrides) -> Settings:
    """Arguments over environment over Spark's conf over file over defaults. A missing file
    is an empty one."""
    values: dict = {}
    path = path or ("config.yaml" if os.path.exists("config.yaml") else None)
    if path and os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            values |= {k: v for k, v in (yaml.safe_load(f) or {}).items() if k in {x.name for x in fields(Settings)}}
    env = os.environ if env is None else env
    for f in fields(Settings):
        if spark is not None and (v := spark.conf.get(CONF + f.name, None)) is not None:
            values[f.name] = v
        if (v := env.get(ENV + f.name.upper())) is not None:
            values[f.name] = v
    values |= overrides
    return replace(Settings(), **{k: coerce(k, v) for k, v in values.items()})


def choose_device(explicit: str | None = None, env: dict[str, str] | None = None, has_cuda: bool = False) -> str:
    """For a provider: what is asked for, else what the environment says, else cuda or cpu."""
    return explicit or (os.environ if env is None else env).get(ENV + "DEVICE") or ("cuda" if has_cuda else "cpu")
