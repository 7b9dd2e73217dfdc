"""Run options: command line before environment before file before default."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, fields


@dataclass
class Options:
    source_lang: str = "auto"
    target_lang: str = "en"
    formats: str = "alto.xml"
    backend: str = "prefix"
    chunk_limit: int = 4000
    chunk_overlap: int = 0
    fast_align: bool = False

    @property
    def layout_mode(self) -> bool:
        """Layout files are asked for."""
        return "alto.xml" in [f.strip().lstrip(".").lower() for f in self.formats.split(",")]


def _typed(kind: type, text: str, default):
    try:
        return text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
    except ValueError:
        return default  # an unreadable value counts as not given


def options(given: dict | None = None, ini: str = "", prefix: str = "LEXLOOM_", env: dict | None = None) -> Options:
    """Options from a mapping, environment variables and the text of an INI file whose section header may be missing."""
    parser = configparser.ConfigParser()
    parser.read_string(ini if ini.lstrip().startswith("[") else "[DEFAULT]\n" + ini)
    file = dict(parser.defaults())
    for section in parser.sections():
        file |= dict(parser[section])
    env = os.environ if env is None else env
    out = Options()
    for f in fields(Options):
        default = getattr(out, f.name)
        for text in (file.get(f.name), env.get(prefix + f.name.upper())):
            if text is not None and text.strip():
                setattr(out, f.name, _typed(type(default), text, getattr(out, f.name)))
        value = (given or {}).get(f.name)
        if value is not None:
            setattr(out, f.name, value)
    return out
