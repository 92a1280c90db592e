"""Labelled pages for the block classifier, made from a seed.

Each page is a list of (html, label) pieces in page order: navigation, notices,
adverts, an article in one of the usual wrappings, and what stands around and
inside articles without being part of them. Words are made of random syllables,
so that nothing can be learned from particular words.
"""

from __future__ import annotations

import numpy as np

PAGES = 400
SEED = 11

ARTICLES = (
    '<article{}>', '<main{}>', '<div class="content"{}>', '<div class="post-body"{}>', '<section class="story"{}>',
    '<div id="article-text"{}>', '<div class="entry-content"{}>', '<div{}>', '<article class="post"{}>', '',
)
NOTICES = ("cookie-notice", "consent-banner", "alert notice", "gdpr-popup", "newsletter-signup", "paywall")
ADVERTS = ("ad", "advert", "ads sponsored", "promo-box", "banner-ad", "sponsor")
SIDES = ("sidebar", "related", "widget", "popular-posts", "share social", "tags", "author-box", "recommended")
COMMENTS = ("comments", "comment-list", "responses", "discussion")


class Writer:
    """Random text and page parts."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def word(self) -> str:
        parts = self.rng.integers(1, 5)
        letters = "bcdfghklmnprstvwz", "aeiouéäö"
        return "".join(
            letters[0][self.rng.integers(len(letters[0]))] + letters[1][self.rng.integers(len(letters[1]))]
            for _ in range(parts)
        )

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.integers(low, high)))

    def prose(self, low: int, high: int) -> str:
        """One to several sentences; sometimes with odd marks between the words."""
        said = [self.words(1, 14).capitalize() + "." for _ in range(self.rng.integers(low, high))]
        text = " ".join(said)
        odd = self.rng.random()
        if odd < 0.08:
            text = text.replace(" ", " | ")
        elif odd < 0.16:
            text = text.replace(" ", "### ")
        elif odd < 0.2:
            text = text.upper().replace(" ", "!! ")
        return text

    def pick(self, options):
        return options[self.rng.integers(len(options))]

    def chance(self, share: float) -> bool:
        return self.rng.random() < share


def _menu(w: Writer, around: str) -> list[tuple[str, int]]:
    items = [(f'<li><a href="#">{w.words(1, 4)}</a></li>', 0) for _ in range(w.rng.integers(3, 9))]
    return [(around + "<ul>", -1), *items, ("</ul></" + around[1:].split()[0].rstrip(">") + ">", -1)]


def _boxed(w: Writer, tag: str, names: tuple[str, ...], kind: str = "class") -> list[tuple[str, int]]:
    name = w.pick(names)
    inner = [(f"<p>{w.prose(1, 4)}</p>", 0)] if w.chance(0.6) else [(w.prose(1, 3), 0)]
    if w.chance(0.4):
        inner.insert(0, (f"<h3>{w.words(1, 5)}</h3>", 0))
    if w.chance(0.4):
        inner.append((f'<p><a href="#">{w.words(1, 5)}</a></p>', 0))
    return [(f'<{tag} {kind}="{name}">', -1), *inner, (f"</{tag}>", -1)]


def _comments(w: Writer) -> list[tuple[str, int]]:
    name, kind = w.pick(COMMENTS), w.pick(("class", "id"))
    out = [(f'<{w.pick(("div", "section"))} {kind}="{name}">', -1), (f"<h3>{w.words(1, 3)}</h3>", 0)]
    for _ in range(w.rng.integers(1, 5)):
        body = w.prose(1, 6)
        inner = f"<p>{body}</p>" if w.chance(0.7) else body
        out.append((f'<div class="{w.pick(("comment", "comment-body", "reply"))}">{inner}</div>', 0))
    return [*out, ("</div></section>", -1)]


def _form(w: Writer) -> list[tuple[str, int]]:
    return [
        ('<form action="#">', -1), (f"<label>{w.words(1, 4)}</label>", 0), ('<input type="text">', -1),
        (f"<p>{w.prose(1, 2)}</p>", 0), (f"<button>{w.words(1, 3)}</button>", 0), ("</form>", -1),
    ]


def _article(w: Writer) -> list[tuple[str, int]]:
    opening = w.pick(ARTICLES)
    out = [(opening.format(""), -1)] if opening else []
    if w.chance(0.8):
        out.append((f"<h1>{w.words(2, 12)}</h1>", 1))
    for _ in range(w.rng.integers(1, 10)):
        kind = w.rng.random()
        if kind < 0.7:
            bold = "<b>" if w.chance(0.15) else ""
            end = "" if w.chance(0.1) else "</p>"
            out.append((f"<p>{bold}{w.prose(1, 7)}{'<br>' if bold else ''}{end}", 1))
        elif kind < 0.78:
            out.append((f"<p>{w.prose(1, 3)} <a href='#'>{w.words(1, 4)}</a> {w.prose(1, 3)}</p>", 1))
        elif kind < 0.84:
            out.append((f"<h2>{w.words(1, 6)}</h2>", 1))
        elif kind < 0.9:
            out += [("<ul>", -1), *[(f"<li>{w.words(2, 15)}</li>", 1) for _ in range(3)], ("</ul>", -1)]
        elif kind < 0.95:
            out.append((f"<blockquote>{w.prose(1, 4)}</blockquote>", 1))
        else:
            out.append((f"<figure><img src='#'><figcaption>{w.words(3, 12)}</figcaption></figure>", 1))
        if w.chance(0.05):
            out += w.pick((_boxed(w, "div", ADVERTS), _boxed(w, "aside", SIDES), _boxed(w, "div", SIDES)))
    if w.chance(0.1):
        out += _comments(w)
    if opening:
        out.append((f"</{opening[1:].split('{')[0].split()[0].rstrip('>')}>", -1))
    return out


def labelled_page(rng: np.random.Generator) -> list[tuple[str, int]]:
    """Pieces of one page; label 1: main text, 0: not, -1: markup only."""
    w = Writer(rng)
    out: list[tuple[str, int]] = [("<html><head><title>x</title><style>p{}</style></head><body>", -1)]
    if w.chance(0.4):
        top = f"<p>{w.words(1, 6)}</p>" if w.chance(0.5) else f"<h1><a href='#'>{w.words(1, 4)}</a></h1>"
        out += [("<header>", -1), (top, 0), ("</header>", -1)]
    if w.chance(0.9):
        out += _menu(w, w.pick(("<nav>", '<div class="menu">', '<div id="nav">', '<nav class="breadcrumb">')))
    if w.chance(0.5):
        out += _boxed(w, "div", ADVERTS)
    if w.chance(0.25):
        out += _boxed(w, w.pick(("div", "section")), NOTICES, w.pick(("class", "id")))
    if w.chance(0.15):
        out += _boxed(w, w.pick(("div", "aside")), SIDES)
    out += _article(w)
    if w.chance(0.3):
        out += _boxed(w, w.pick(("div", "aside")), SIDES)
    if w.chance(0.25):
        out += _comments(w)
    if w.chance(0.2):
        out += _form(w)
    if w.chance(0.2):
        out += _boxed(w, "div", ADVERTS)
    if w.chance(0.9):
        tag = w.pick(("footer", 'div class="footer"', 'div id="footer"'))
        said = "&copy; " * w.chance(0.6) + w.words(1, 3) + " &middot; " * w.chance(0.5) + w.prose(1, 3)
        inner = f"<p>{said}</p>" if w.chance(0.4) else said
        out += [(f"<{tag}>", -1), (inner, 0), (f"</{tag.split()[0]}>", -1)]
    return [*out, ("</body></html>", -1)]


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[list[tuple[str, int]]]:
    rng = np.random.default_rng(seed)
    return [labelled_page(rng) for _ in range(pages)]
