"""The extractor on ordinary class names and page shapes, and its scan against brute force."""

import random

import pytest

STORY = [("The council met on Monday and talked about the old bridge for three hours, and most of the members wanted it kept. "
          "A new plan is to be drawn by the spring."),
         "Two engineers showed what the repair would cost, and how long the road would have to be closed.",
         "People who live by the river said that they had been promised a footpath ten years ago.", "It was late."]
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Start", "News", "Town", "Help", "Jobs", "Shop"))
BODY = "".join(f"<p>{p}</p>" for p in STORY)
TEXT = "\n".join(STORY)


def page(inner, after=""):
    return (f'<html><head><title>x</title></head><body><nav><ul>{LINKS}</ul></nav>{inner}{after}'
            f'<footer><p>All rights reserved by the town.</p><ul>{LINKS}</ul></footer></body></html>')


def got(html):
    from corpusflow.llm.html_pages import LABELLED_PAGES
    from corpusflow.llm.html_text import learn, main_text

    return main_text(html, learn(LABELLED_PAGES))


ARTICLE = ["post tag-advertising category-news", "post category-social", "post tag-cookies", "post-42 tag-search hentry",
           "h-entry type-post category-reviews", "story comments-enabled", "post has-comments", "article-notice", "page social-policy",
           "post tag-print", "notice", "x1 y2"]
DIV = ["content has-ads", "main-with-comments", "story social", "reviews", "page-print", "node-related", "text-secondary", "wp-block-group", ""]


@pytest.mark.parametrize("name", ARTICLE)
def test_articles_with_ordinary_class_names(name):
    assert got(page(f'<article class="{name}">{BODY}</article>')) == TEXT


@pytest.mark.parametrize("name", DIV)
def test_divisions_with_ordinary_class_names(name):
    assert got(page(f'<div class="{name}">{BODY}</div>')) == TEXT


def test_section_named_reviews_in_an_article_stays():
    more = "The inspectors gave the bridge good marks for its stone work and poor ones for the railing."
    assert got(page(f'<article>{BODY}<section class="reviews"><p>{more}</p></section></article>')) == f"{TEXT}\n{more}"


def test_form_around_the_page_and_forms_in_it():
    search = '<form class="search"><input name="q"> Search the whole site</form>'
    assert got(f'<html><body><form id="form1"><div class="menu">{LINKS}</div><div class="text">{BODY}</div></form></body></html>') == TEXT
    assert got(page(f"<header>{search}</header><div>{BODY}<form>Your name and mail, please</form></div>")) == TEXT


CARD = "<article><h3><a href='/a'>Snow in May</a></h3><p>It fell for an hour and was gone by noon.</p></article>"


def test_story_beside_article_cards():
    assert got(page(f'<div class="story">{BODY}</div>', f'<section class="latest">{CARD}{CARD}</section>')) == TEXT
    assert got(page(f"<main><div>{BODY}</div><div>{CARD}{CARD}{CARD}</div></main>")) == TEXT
    assert got(page(f"<section>{CARD}{CARD}</section><div><h1>The bridge</h1>{BODY}</div>")) == f"The bridge\n{TEXT}"


@pytest.mark.parametrize("box", [
    '<div class="ad">Buy a new coat this week and save a lot of money at the shop.</div>',
    '<div class="comments"><p>I was there and it was loud.</p><p>They should build a new one, I think.</p></div>',
    '<aside><h3>About the town</h3><p>It lies by the river and has two mills.</p></aside>',
    '<div class="share social">Share this with all your friends today</div>', '<div hidden>Not to be seen by any reader of it</div>',
    '<section id="comments"><article class="comment"><p>Long live the old bridge and all its stones.</p></article></section>',
    '<div class="cookie-banner notice">We use cookies to count our visitors and to make the site better.</div>',
    '<div class="newsletter promo">Get our letter by mail every Friday at noon</div>', "<script>var a = 'words words words';</script>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="story">{}</div>', "<main>{}</main>"])
def test_boilerplate_in_and_after_the_story(box, frame):
    half = "".join(f"<p>{p}</p>" for p in STORY[:2])
    rest = "".join(f"<p>{p}</p>" for p in STORY[2:])
    assert got(page(frame.format(half + box + rest))) == TEXT
    assert got(page(frame.format(BODY), box)) == TEXT


def test_long_comments_do_not_become_the_story():
    talk = "".join(f"<p>{p}</p>" for p in STORY * 4)
    assert got(page(f'<div class="text"><p>{STORY[0]}</p><p>{STORY[1]}</p></div><div class="comments">{talk}</div>')) == "\n".join(STORY[:2])


def test_scan_equals_the_best_of_all_regions():
    from corpusflow.llm.html_text import best_region

    r = random.Random(6)
    for _ in range(500):
        scores = [r.choice([-3, -1, -0.5, 0, 0.5, 2, 4]) for _ in range(r.randrange(25))]
        sums = [(sum(scores[i:j]), i, j - 1) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        top, first, last = best_region(scores)
        assert top == max([0.0, *(s for s, _, _ in sums)])
        assert last < 0 or sum(scores[first:last + 1]) == top


def test_the_scan_decides(monkeypatch):
    """With the whole page as the region, texts beside the story come in."""
    from corpusflow.llm import html_text

    teasers = "".join(f'<div><h3><a href="/{i}">Snow in May</a></h3><div>gone by noon</div></div>' for i in range(5))
    html = page(f"<div>{BODY}</div><div>{teasers}</div>")
    assert got(html) == TEXT
    monkeypatch.setattr(html_text, "best_region", lambda scores: (1.0, 0, len(scores) - 1))
    assert "Snow in May" in got(html)


def test_unlabelled_weights_follow_the_pages():
    from corpusflow.llm.html_text import learn, main_text

    # on these sites the text is in elements named "strange", and "story" is boilerplate
    pages = [f'<html><body><div class="strange"><p data-main>{STORY[0]}</p></div><div class="story"><p>{STORY[1]}</p></div></body></html>'] * 6
    assert main_text(f'<html><body><div class="story"><p>{STORY[1]}</p></div><div class="strange"><p>{STORY[0]}</p></div></body></html>',
                     learn(pages)) == STORY[0]
