from pathlib import Path

from strandflow.llm.langid import Setup


def test_bounds_of_the_language_sample_are_those_in_use():
    s, text = Setup(), (Path(__file__).parents[2] / "README.md").read_text()
    assert f"language {s.per_class:,} of each language and {s.sample_bytes >> 20} MB (profiles of 2**{s.bits} buckets)" in text
