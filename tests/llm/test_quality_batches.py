"""Scores of a text do not depend on the texts around it."""

import numpy as np

from credence.llm import quality


def test_features_do_not_depend_on_neighbours():
    texts = ["The House. THE house stands IN Water", "Straße Σας ΟΔΟΣ É"]
    alone = np.concatenate([quality.features([t]) for t in texts])
    for odd in ("\u0130stanbul", "ŉ", "ß", ""):
        assert np.array_equal(quality.features([*texts, odd])[:2], alone)
    assert quality.upper_case()[0x130] and quality.upper_case()[ord("É")] and not quality.upper_case()[ord("é")]
