"""Small corpora with planted duplicates."""

from __future__ import annotations


def exact_rows() -> list[tuple[int, str | None]]:
    """500 documents with three groups of copies under white space."""
    text = {i: f"unique document number {i} lorem ipsum" for i in range(500)}
    pads = {
        "alpha document about climbing": {3: ("", ""), 117: ("  ", "  "), 360: ("\n\t", "\n\t"), 499: ("   \n  ", "   \n  ")},
        "beta document": {50: ("", ""), 250: ("\n", "\n")},
        "gamma same shard twice": {105: ("", ""), 106: (" ", " "), 107: ("\t\n", "\t\n")},
    }
    for body, places in pads.items():
        for i, (a, b) in places.items():
            text[i] = a + body + b
    return sorted(text.items())


def words(tag: str, changed: dict[range, str] | None = None, n: int = 600) -> str:
    out = [f"{tag}w{i}" for i in range(n)]
    for places, mark in (changed or {}).items():
        for i in places:
            out[i] = f"{tag}{mark}{i}"
    return " ".join(out)


def near_rows() -> dict[int, str]:
    """Families F and C, a pair of copies D, and unrelated documents; ids as 1000 * shard + row."""
    rows = {
        5: words("f"), 1020: words("f", {range(10, 16): "x"}), 2040: words("f", {range(300, 306): "x"}), 3060: words("f", {range(500, 560): "x"}),
        90: words("c", {range(40): "x"}), 1100: words("c"), 2110: words("c", {range(550, 590): "x"}), 3120: words("d"), 130: words("d"),
    }
    rows |= {1000 * s + r: words(f"z{s}q{r}q") for s in range(4) for r in range(200, 206)}
    return rows


def record_rows() -> dict[int, str]:
    rows = {10: words("f"), 1020: words("f", {range(20, 28): "x"}), 30: words("f", {range(400, 410): "x"}), 2040: words("f", {range(400, 410): "x"})}
    return rows | {3000 + r: words(f"z{r}q") for r in range(5)}
