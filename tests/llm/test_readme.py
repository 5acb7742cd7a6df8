"""Settings that the README states are those that run."""

import os

from quillspark.llm import neardup


def test_bands_of_near_duplicates():
    with open(os.path.join(os.path.dirname(__file__), "../../README.md"), encoding="utf-8") as f:
        said = " ".join(f.read().split())
    assert f"op9: {neardup.BANDS} bands of {neardup.band_plan(0.85)} coordinates ({neardup.band_plan(0.8)} at a threshold of 0.8)" in said
