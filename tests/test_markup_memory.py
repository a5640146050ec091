"""What the walk over wiki markup holds."""

import tracemalloc

from sievespark.functions.markup import wiki_text


def test_a_walk_holds_runs_not_characters():
    text = "some words of a text\n" * 20_000
    tracemalloc.start()
    try:
        assert wiki_text(text) == text.strip()
        assert tracemalloc.get_traced_memory()[1] < 12 * len(text)
    finally:
        tracemalloc.stop()
