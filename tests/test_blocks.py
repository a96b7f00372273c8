import json
import random

from vellum.functions import blocks as B

NOTE = """# Title
first line
goes on

- one
  - two
    more of two
  - [x] done
- three

1. first
2. second

> [!note]- Head
> inside
> > deeper
> - item
back

| a | b \\| c |
|---|:-:|
| 1 | 2 |

```python
x = 1

# no heading
```
***
%% hidden %%
![[pic.png|300]]
- [ ] open"""


def tree(text):
    return [(r[1], r[2], r[3], r[4], r[5], json.loads(r[6]) if r[6] else {}) for r in B.rows_of(B.parse(text))]


def test_a_note():
    assert [(d, k, t) for _, _, d, k, t, _ in tree(NOTE)] == [
        (0, "heading", "Title"), (0, "paragraph", "first line goes on"), (0, "bullet", "one"), (1, "bullet", "two"), (2, "paragraph", "more of two"), (1, "to_do", "done"), (0, "bullet", "three"),
        (0, "number", "first"), (0, "number", "second"), (0, "callout", "Head"), (1, "paragraph", "inside"), (1, "quote", ""), (2, "paragraph", "deeper"), (1, "bullet", "item"), (0, "paragraph", "back"),
        (0, "table", ""), (1, "row", ""), (1, "row", ""), (0, "code", "x = 1\n\n# no heading"), (0, "rule", ""), (0, "image", "pic.png"), (0, "to_do", "open"),
    ]
    more = {(k, t): m for _, _, _, k, t, m in tree(NOTE)}
    assert more["callout", "Head"] == {"type": "note", "fold": "-"} and more["to_do", "done"] == {"checked": True} and more["code", "x = 1\n\n# no heading"] == {"language": "python"}
    rows = [m for _, _, _, k, _, m in tree(NOTE) if k == "row"]
    assert rows == [{"cells": ["a", "b | c"]}, {"cells": ["1", "2"]}]


def noise(seed):
    random.seed(seed)
    lines = ["", "", "words here", "more", "# H", "### H3", "- a", "  - b", "    - c", "1. n", "3) m", "- [x] t", "> q", ">", "> > qq", "> - qi", "> [!tip] T", "| a | b |", "|---|---|", "```", "```py", "---", "%% c %%", "![[p]]", "  text", "\ttab", "-", "|", "*"]
    return "\n".join(random.choice(lines) for _ in range(random.randint(0, 25)))


def test_what_is_written_reads_the_same():
    for seed in range(3_000):
        first = list(B.rows_of(B.parse(noise(seed))))
        text = B.written(first)
        assert list(B.rows_of(B.parse(text))) == first, (seed, noise(seed), text)


def test_rows_and_texts(spark):
    texts = {k: noise(k) for k in range(40)} | {40: NOTE}
    frame = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(98, None), (99, "")], "id long, text string").repartition(3)
    rows = B.block_rows(frame, "id")
    found = {}
    for r in rows.collect():
        found.setdefault(r.id, []).append((r.pos, r.parent, r.place, r.depth, r.kind, r.text, r.more))
    assert {k: sorted(v) for k, v in found.items()} == {k: list(B.rows_of(B.parse(t))) for k, t in texts.items() if list(B.rows_of(B.parse(t)))}
    again = B.block_rows(B.markdown_of(rows, "id"), "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
