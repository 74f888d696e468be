"""Weights and scan decide on every page; marks of a page only label it for learning."""

import collections
import re

import pyarrow as pa
import pyarrow.parquet as pq

from cohortloom.llm import main_text

PAGES = "/root/testdata/sf0.01/pages.parquet"
STORY = "one two three four five six seven eight nine ten eleven twelve " * 3


def test_articles_that_are_not_the_text():
    for page in (f'<p>{STORY}</p><div class="related"><article>teaser</article></div>', f"<p>{STORY}</p><aside><article>teaser</article></aside>",
                 f"<p>{STORY}</p><!-- <article> -->", f'<p>{STORY}</p><script>var t="<article>"</script>',
                 f"<div><p>{STORY}</p></div><article class=card><p>some teaser words</p></article>"):
        assert main_text.main_text(page, {}) == STORY.strip()


def test_pages_kept_apart_without_their_marks():
    """Learned on four fifths of the pages; on the others the marks are taken away before the text is looked for."""
    pages = pq.read_table(PAGES).column("html").to_pylist()
    known = [p for i, p in enumerate(pages) if i % 5]
    count = collections.defaultdict(lambda: [0, 0])
    for b in main_text.counted(iter([pa.RecordBatch.from_arrays([pa.array(known)], ["html"])])):
        for r in b.to_pylist():
            count[r["kind"], r["tag"]][0] += r["n"]
            count[r["kind"], r["tag"]][1] += r["n"] * r["inside"]
    share = {k: (inside + 0.5) / (n + 1) for k, (n, inside) in count.items()}
    scores = []
    for p in pages[::5]:
        marked = main_text.main_text(re.search(r"<article\b.*?(?:</article>|$)", p, re.S)[0], {})
        found = main_text.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", p), share)
        a, b = collections.Counter(marked.split()), collections.Counter(found.split())
        scores.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert len(scores) == 50 and sum(scores) / 50 >= 0.95
