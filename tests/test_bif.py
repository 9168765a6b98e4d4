"""Networks in the interchange format."""

import numpy as np

from credence.sources.generators import materialize_expert_networks, read_bif

TEXT = """network unknown { }
variable B { type discrete [ 2 ] { yes, no }; }
variable A { type discrete [ 3 ] { low, mid, high }; }
variable LowerBodyO2 { type discrete [ 2 ] { a, b }; }
probability ( A ) { table 0.2, 0.3, 0.5; }
probability ( B | A ) { (low) 0.9, 0.1; (mid) 0.5, 0.5; (high) 0.0, 1.0; }
probability ( LowerBodyO2 | B, A ) {
  (yes, low) 1.0, 0.0; (no, low) 0.0, 1.0; (yes, mid) 0.5, 0.5; (no, mid) 0.5, 0.5; (yes, high) 0.25, 0.75; (no, high) 0.75, 0.25;
}
"""


def test_tables_have_parents_in_name_order():
    graph, cards, tables, states = read_bif(TEXT)
    assert graph.edges() == [("B", "LowerBodyO2"), ("A", "B"), ("A", "LowerBodyO2")] and cards == {"B": 2, "A": 3, "LowerBodyO2": 2}
    assert states["A"] == ["low", "mid", "high"] and tables["A"].tolist() == [[0.2, 0.3, 0.5]]
    assert tables["LowerBodyO2"].tolist() == [[1, 0], [0, 1], [0.5, 0.5], [0.5, 0.5], [0.25, 0.75], [0.75, 0.25]]  # (A, B)


def test_published_tables_are_sampled(spark, tmp_path):
    (tmp_path / "child").mkdir()
    (tmp_path / "child" / "network.bif").write_text(TEXT)
    out = materialize_expert_networks(spark, str(tmp_path), ["child"])
    assert out["child"]["status"] == "written" and out["child"]["edges"] == 3
    import pandas as pd

    frame = pd.read_csv(tmp_path / "child" / "frame.csv")
    assert len(frame) == 2500 and set(frame["A"]) == {"low", "mid", "high"} and not ((frame["A"] == "high") & (frame["B"] == "yes")).any()
    assert (frame[(frame["A"] == "low") & (frame["B"] == "yes")]["LowerBodyO2"] == "a").all()
    assert np.isclose((frame["A"] == "high").mean(), 0.5, atol=0.05)
