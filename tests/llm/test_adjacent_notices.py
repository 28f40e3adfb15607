"""Edited license notices next to each other."""

from __future__ import annotations

from ambientspark.llm import licenses


def found(text):
    return [(x[0], x[6]) for x in licenses.scan_text(text.encode(), (), tuple(licenses.NOTICES.items()))[1]]


def test_edited_notice_before_a_better_one_of_another_version():
    two = "licensed under the gnu general public license version 2"
    assert found(f"licensd undr the gnu general public license version 3 or {two}") == [("gpl-3", 2), ("gpl-2", 0)]


def test_edited_notices_on_adjacent_lines():
    lines = ["licensd undr the gnu afero general public license", "licensed under the gnu affero general public license", "licensed undr the gnu affero general public license"]
    for order in ((0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 2, 1, 0)):
        assert found("\n".join(lines[k] for k in order)) == [("agpl", (3, 0, 1)[k]) for k in order]
