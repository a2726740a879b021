"""Small texts shared by the tests of this folder."""

import re

import numpy as np

from winnow.llm import common

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def words(text: str | None) -> list[str]:
    return re.findall(common.WORD, text or "")
