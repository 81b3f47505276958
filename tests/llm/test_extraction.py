"""Pages whose main text isn't where tag names and class words say."""

import os
import re
from html.parser import HTMLParser

import pytest

from cairn.llm import extraction
from cairn.llm.extraction import main_text

SENTENCES = [f"Sentence {i} of the text, with a clause, a second one, and an end that is some words away." for i in range(12)]
PARAGRAPHS = [" ".join(SENTENCES[i : i + 3]) for i in range(0, 12, 3)]
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)


def test_ratios_decide_on_pages_with_article_or_main():
    teaser = main_text(f"<body><div>{BODY}</div><article><h3>More</h3><p>A card.</p></article></body>")
    assert teaser.split("\n")[:4] == PARAGRAPHS
    stray = main_text(f"<body><main><div><span>Filed under misc</span></div><section><h1>Title</h1>{BODY}</section><div><ul><li>Print</li><li>Send</li></ul></div></main></body>")
    assert stray == "\n".join(["Title", *PARAGRAPHS])
    mixed = main_text(f"<body><article><h1>T</h1>{BODY}<div>Short note</div><p>Also.</p></article></body>")
    assert mixed == "\n".join(["T", *PARAGRAPHS, "Short note", "Also."])


def test_sections_beside_the_largest_stay():
    for tag in ("div", "section"):
        two = main_text(f"<body><div><{tag}>{BODY}</{tag}><{tag}><h2>Part two</h2><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></{tag}></div></body>")
        assert two == "\n".join([*PARAGRAPHS, "Part two", *PARAGRAPHS[:2]])
    many = main_text("<body>" + f"<section>{BODY * 3}</section>" + "".join(f"<section><p>{x}</p></section>" for x in PARAGRAPHS) + "</body>")
    assert many == "\n".join(PARAGRAPHS * 4)
    code = main_text("<body><div>" + f"<section>{BODY}<div><pre>x = 1</pre></div></section>" + f"<section>{BODY}</section></div><div>Stray words</div></body>")
    assert code == "\n".join([*PARAGRAPHS, "x = 1", *PARAGRAPHS])


def test_tags_and_marks_hide_no_text():
    text = "\n".join(PARAGRAPHS)
    for odd in ('<svg class="i"/>', "<svg-icon></svg-icon>", "<button-group>", "<object data=x>", "<button>", "<iframe src=x>", "<select>", "<title-bar></title-bar>", "<template>"):
        assert main_text(f"<body><div>{odd}{BODY}</div></body>") == text, odd
        assert main_text(f"<body><div>{odd}{BODY}</div><p>Go on <button>x</button></p><svg><title>t</title></svg></body>").startswith(text), odd
    hidden = main_text(f"<body><div>{BODY}<svg><svg>one</svg>two</svg><script>a<b</script ><button>three</button><select><option>four</select></div></body>")
    assert hidden == text
    for name in ("class='content has-sidebar'", "class='comments-open'", "id='search-results'", "class='widget'"):
        assert main_text(f"<body><div {name}>{BODY}<div class=comments><p>Nice.</p></div></div><div class=sidebar>Side words</div></body>") == text, name
    assert main_text(f"<body><form><nav><a href=/>Home</a></nav><div>{BODY}</div></form></body>") == text
    thirds = main_text("<body>" + "".join(f"<div class=widget><p>{x}</p></div>" for x in PARAGRAPHS) + "<nav><a href=/>Home</a></nav></body>")
    assert thirds == text
    assert main_text("<body><div class=ad>An advert of more words than the text.</div><article><p>Text.</p></article></body>") == "Text."


def test_words_of_a_main_element_hide_nothing():
    text = "\n".join(PARAGRAPHS)
    for name in ("has-comments", "post login-guide", "content no-sidebar", "sidebar", "comments"):
        assert main_text(f"<body><article class='{name}'>{BODY}</article></body>") == text, name
        assert main_text(f"<body><div class='{name}'><main><article>{BODY}</article></main></div><div class=ad><p>Buy this, now.</p></div></body>") == text, name
    for comments in ("<section class=readers><p>I liked it, really.</p></section>", "<div id=comments><ol><li><article class=comment><p>I liked it, really.</p></article></ol></div>"):
        assert main_text(f"<body><article>{BODY}{comments}</article></body>") == text
        assert main_text(f"<body><main>{BODY}{comments}</main></body>") == text


def test_deep_nesting_and_long_pages_lose_nothing():
    deep = main_text("<body><article>" + "".join(f"<div><p>{PARAGRAPHS[i % 4]} {i}.</p>" for i in range(900)) + f"</article><nav><a href=/>Home</a></nav></body>")
    assert deep.split("\n") == [f"{PARAGRAPHS[i % 4]} {i}." for i in range(900)]
    assert main_text("<div>" * 50_000 + BODY + "</section>" * 50_000 + "</div>" * 50_000) == "\n".join(PARAGRAPHS)
    assert main_text(f"<body><article>{BODY * 5000}</article></body>") == "\n".join(PARAGRAPHS * 5000)


def test_scores_decide_on_every_page(monkeypatch):
    page = f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div><article>{BODY}</article></div><footer>Rights, reserved.</footer></body>"
    assert main_text(page) == "\n".join(PARAGRAPHS)
    monkeypatch.setattr(extraction, "path_scores", lambda blocks: {node.path: 1.0 for node, _, _ in blocks})
    assert main_text(page) == "\n".join(["Home", *PARAGRAPHS, "Rights, reserved."])


class Plain(HTMLParser):
    """The pages' blocks once more, as (chain of [tag, words], text, link characters), with the library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.chain, self.blocks, self.held, self.links, self.link, self.hidden = [["", set()]], [], "", 0, False, 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join(self.held.split()):
            self.blocks.append((list(self.chain), text, self.links))
        self.held, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in extraction.RAW | extraction.HIDDEN:
            self.hidden += 1
        elif tag in extraction.INLINE:
            self.link = True if tag == "a" else self.link
        elif tag in extraction.VOID:
            self.held += " "
        else:
            self.flush()
            self.link = False
            last = self.chain[-1][0]
            if (last == "p" and tag in extraction.CLOSES_P) or (last == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                self.chain.pop()
            names = [n for k, v in attrs if k in ("class", "id", "role") and v for n in v.lower().split()]
            parts = [re.split(r"[^a-z0-9]+", n) for n in names]
            self.chain.append([tag, {w for p in parts if not extraction.STATE_WORDS & set(p) for w in p}])

    def handle_endtag(self, tag):
        if tag in extraction.RAW | extraction.HIDDEN:
            self.hidden -= 1
        elif tag in extraction.INLINE:
            self.link = False if tag == "a" else self.link
        elif tag not in extraction.VOID:
            self.flush()
            self.link = False
            if tag in [t for t, _ in self.chain]:
                while self.chain.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.hidden:
            self.held += data
            self.links += len(data) * self.link


def plain_text(html):
    blocks = Plain(html).blocks
    if not blocks:
        return ""
    in_main = lambda chain: [e for e in chain if e[0] in ("article", "main")]
    most = sum(max(len(t) - n, 0) for c, t, n in blocks if in_main(c))
    exempt = []
    for e in [e for c, _, _ in blocks for e in in_main(c)]:
        mine = [(c, t, n) for c, t, n in blocks if any(x is e for x in c)]
        if sum(max(len(t) - n, 0) for _, t, n in mine) * 2 >= most > 0:
            chain = mine[0][0]
            exempt += chain[: next(i for i, x in enumerate(chain) if x is e) + 1]

    def marked(chain, i):
        tag, words = chain[i]
        inside = bool(in_main(chain[:i]))
        if tag in extraction.OUTSIDE - {"form"} or (tag == "header" and not inside):
            return True
        named = tag == "form" or (tag not in ("html", "body") and words & extraction.OUTSIDE_WORDS) or (not inside and words & extraction.HEADER_WORDS)
        return bool(named) and not any(chain[i] is x for x in exempt)

    paths = [tuple((c[i][0], marked(c, i)) for i in range(len(c))) for c, _, _ in blocks]
    marks = [sum(m for _, m in p) for p in paths]
    mean = lambda p, f: sum(f(t, n) for q, (_, t, n) in zip(paths, blocks) if q == p) / paths.count(p)
    ratio = [[mean(p, f) for p in paths] for f in (lambda t, n: len(t), lambda t, n: sum(x in ".,;:!?…。，；：！？、" for x in t), lambda t, n: min(n, len(t)))]
    at = lambda x, i: x[min(max(i, 0), len(x) - 1)]
    smooth = lambda x, i: (at(x, i - 1) + 2 * x[i] + at(x, i + 1)) / 4
    own = [smooth(ratio[0], i) * (1 + smooth(ratio[1], i)) * (1 - ratio[2][i] / ratio[0][i]) * 0.02 ** (marks[i] - min(marks)) * (2 if in_main(blocks[i][0]) else 1) for i in range(len(blocks))]
    score = [sum(s for s, q in zip(own, paths) if q == p) / paths.count(p) for p in paths]
    good = [s >= 0.15 * max(score) * (1 - 1e-12) for s in score]
    section = [next(e for e in reversed(c) if e[0] not in extraction.WITHIN_SECTION) for c, _, _ in blocks]
    top = [next((e for e in c if e[0] not in ("", "html", "body")), None) for c, _, _ in blocks]
    out = []
    for i, (_, text, links) in enumerate(blocks):
        before, after = [j for j in range(i) if good[j]][-1:], [j for j in range(i, len(blocks)) if good[j]][:1]
        near = [marks[j] for j in range(len(blocks)) if good[j] and section[j] is section[i]]
        if before and after and (section[before[0]] is section[after[0]] or (top[before[0]] is top[after[0]] and top[after[0]])):
            near += [marks[before[0]], marks[after[0]]]
        if good[i] or (2 * links <= len(text) and near and marks[i] <= max(near)):
            out.append(text)
    return "\n".join(out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_plain_loops_agree_on_all_pages():
    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist():
        assert main_text(html) == plain_text(html or "")
