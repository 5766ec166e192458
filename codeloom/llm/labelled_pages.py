"""Labelled pages from which html_extract learns its weights: (html, texts of the content blocks). Written for this:
layouts of many kinds, filled by rule from word lists with a fixed seed, so that every run learns the same."""

from __future__ import annotations

import random
from collections.abc import Callable

# Words of the invented prose, what boilerplate says, and names of elements as site builders give them.
SUBJECTS = "river village council farmer engine harbour winter letter market bridge teacher garden forest signal mountain ship painter valley library doctor railway field kitchen island tower".split()
VERBS = "rose changed carried found crossed opened kept built watched followed reached covered painted closed measured lost moved held began described".split()
PLACES = "near the old mill|before it grew dark|for most of the year|after a long debate|in the lower town|without any help|on the third day|along the northern road|at the end of the century|under a grey sky".split("|")
COOKIES = ["We use cookies to improve your experience.", "By using this site you accept our cookie policy.", "Accept all cookies", "Manage your privacy settings."]
BEGGING = ["Subscribe to our newsletter and never miss an update.", "Sign up for free and get the best stories in your inbox.", "Log in or create an account to continue.", "Follow us and share this with your friends."]
ADVERTS = ["Buy now and save today.", "Advertisement", "Sponsored content from our partners.", "Limited offer, order online now."]
LEGAL = ["Copyright 2021. All rights reserved.", "All rights reserved. Terms of use and privacy policy.", "Powered by our own software."]
REMARKS = ["First!", "I was there and it was worse than this.", "Great post, thanks for sharing.", "Reply", "Could not agree more with the writer."]
LINKS = "Home|News|Sport|Contact|About us|Archive|Most read|Shop|Weather|Older story|Next page|Privacy".split("|")
NOISE_NAMES = (
    "ad|ads|ad-slot|ad-box|adbox|adsense|advert|advertisement|banner|top-banner|ad-banner|breadcrumb|breadcrumbs|comment|comments|comment-list|comment-body|comments-area|comment-form|comment-reply|user-comments|cookie|"
    "cookies|cookie-bar|cookie-notice|cookie-consent|cookie-banner|consent|consent-box|gdpr|disqus|disqus-thread|masthead|menu|main-menu|top-menu|menu-item|side-menu|modal|modal-box|nav|navbar|nav-bar|nav-links|nav-item|"
    "navigation|site-nav|newsletter|newsletter-box|newsletter-form|notice|notices|site-notice|pager|pagination|popup|popup-box|promo|promo-box|promoted|related|related-posts|related-links|related-articles|related-stories|"
    "replies|reply-list|respond|share|share-bar|share-buttons|share-links|sharing|share-box|sidebar|sidebar-left|sidebar-right|left-sidebar|right-sidebar|skip-link|skip|social|social-links|social-share|social-buttons|"
    "social-bar|sponsor|sponsored|sponsored-links|subscribe|subscribe-box|toolbar|widget|widgets|widget-area|sidebar-widget|complementary|contentinfo|disclaimer|footer|site-footer|page-footer|footer-links|footer-bar|"
    "header|site-header|page-header|top-header|header-bar|login-box|login-form|tags-list|most-read|trending|trending-box|site-info|site-menu|language-menu|search-box|search-form|search-bar"
).split("|")
CONTENT_NAMES = (
    "article|article-body|article-text|story|story-body|post|post-body|post-content|entry|entry-content|entry-header|article-header|post-header|text|body-text|page-body|page|page-main|site|site-content|main-content|"
    "column|chapter|recipe|recipe-steps|ingredients|poem|verse|lecture|interview|report|abstract|summary|thesis|speech|minutes|biography|obituary|"
    "travelogue|manual|tutorial|lesson|essay|review-text|plot|synopsis|discography|timeline|transcript|question|answer|definition|example|proof|theorem|method|results|discussion|law|statute|case-history|price-table|"
    "share-capital|social-studies|related-work|commentary-on-verse|notice-of-death|footer-of-letter|banner-of-arms|menu-of-feast|nav-ship|tracklist|figure-caption|gallery|photo|map-legend|weather-report|match-report|"
    "score-table|cast|crew|letter|diary|hymn|glossary|appendix|preface|epilogue|dialogue|scene|stanza|procedure|dosage|symptoms|habitat|taxonomy|etymology|geology|climate|economy|history|culture"
).split("|")
PARTS = "wrapper|container|inner|outer|area|list|block|section|module|item|group|primary|secondary|top|bottom|left|right|main|title|box|panel|row|col|wrap|holder|meta|info|content".split("|")


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.content: list[str] = []

    def sentence(self) -> str:
        r = self.rng
        return f"The {r.choice(SUBJECTS)} {r.choice(VERBS)} the {r.choice(SUBJECTS)} {r.choice(PLACES)}."

    def prose(self, most: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def kept(self, tag: str, text: str) -> str:
        self.content.append(text)
        return f"<{tag}>{text}</{tag}>"

    def title(self) -> str:
        return self.kept(f"h{self.rng.randint(1, 3)}", f"The {self.rng.choice(SUBJECTS)} and the {self.rng.choice(SUBJECTS)}")

    def paragraphs(self, n: int) -> str:
        return "".join(self.kept("p", self.prose()) for _ in range(n))

    def items(self, n: int) -> str:
        return "<ul>" + "".join(self.kept("li", self.sentence()) for _ in range(n)) + "</ul>"

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{self.rng.choice(LINKS)}</a></li>" for i in range(n)) + "</ul>"

    def name(self, names: list[str]) -> str:
        """One of names, now and then with a word that any site has in its names."""
        name = self.rng.choice(names)
        return f"{name}-{self.rng.choice(PARTS)}" if self.rng.random() < 0.3 else name

    def noise(self) -> str:
        kind = self.rng.randrange(6)
        if kind == 5:
            inner = self.links(self.rng.randint(3, 9))
        else:
            says = [COOKIES, BEGGING, ADVERTS, REMARKS, LEGAL][kind]
            inner = "".join(f"<p>{self.rng.choice(says)}</p>" for _ in range(self.rng.randint(1, 4)))
        return f"<div {self.rng.choice(('class', 'id'))}='{self.name(NOISE_NAMES)}'>{inner}</div>"

    def named(self, inner: str, tag: str = "div") -> str:
        return f"<{tag} class='{self.name(CONTENT_NAMES)}'>{inner}</{tag}>"


def _article(w: _Writer) -> str:
    return f"<nav>{w.links(6)}</nav>{w.noise()}<article>{w.title()}{w.paragraphs(3)}{w.noise()}{w.paragraphs(2)}</article>{w.noise()}{w.noise()}<footer>{LEGAL[0]}</footer>"


def _main(w: _Writer) -> str:
    return f"<header><div class='logo'>The Daily</div>{w.links(4)}</header><main>{w.title()}{w.paragraphs(2)}{w.items(4)}</main>{w.noise()}<aside>{w.links(5)}</aside>"


def _divs(w: _Writer) -> str:
    return f"{w.noise()}<div>{w.noise()}{w.named(w.title() + w.paragraphs(4))}</div>{w.noise()}<p><a href=t>Terms</a> <a href=p>Privacy</a></p>"


def _flat(w: _Writer) -> str:
    return f"{w.links(8)}{w.title()}{w.paragraphs(5)}{w.links(7)}<p>{LEGAL[1]}</p>"


def _forum(w: _Writer) -> str:
    posts = "".join(w.named(w.paragraphs(2)) for _ in range(3))
    return f"{w.noise()}{w.title()}{posts}{w.noise()}<form>Your mail <input name=m><button>Send</button></form>"


def _gallery(w: _Writer) -> str:
    figures = "".join(f"<figure><img src={i}.jpg>{w.kept('figcaption', w.sentence())}</figure>" for i in range(4))
    return f"<nav>{w.links(4)}</nav>{w.named(w.title() + w.paragraphs(1) + figures)}{w.noise()}"


def _table(w: _Writer) -> str:
    rows = "".join(f"<tr>{w.kept('td', w.sentence())}{w.kept('td', w.sentence())}</tr>" for _ in range(3))
    return f"<table><tr><td>{w.links(6)}</td><td>{w.title()}{w.paragraphs(3)}<table>{rows}</table></td></tr></table><p>{LEGAL[2]}</p>"


def _sections(w: _Writer) -> str:
    parts = "".join(w.named(w.title() + w.paragraphs(2) + w.kept("blockquote", w.prose(2)), "section") for _ in range(2))
    return f"<header>{w.links(5)}</header>{w.noise()}{parts}{w.noise()}<footer>{w.links(3)}</footer>"


LAYOUTS: list[Callable[[_Writer], str]] = [_article, _main, _divs, _flat, _forum, _gallery, _table, _sections]


def labelled_pages(seeds: range) -> list[tuple[str, list[str]]]:
    """A page of each layout for each seed."""
    out = []
    for seed in seeds:
        for i, layout in enumerate(LAYOUTS):
            w = _Writer(1000 * seed + i)
            body = layout(w)
            out.append((f"<html><head><title>{w.sentence()}</title></head><body>{body}</body></html>", w.content))
    return out


#: The seeds that weights are learnt from; others are there to measure with.
TRAINING = range(90)
