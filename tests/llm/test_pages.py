"""Pages that are unkind to the extraction of the main text."""

import time

import pytest

from fleetlens.llm.main_text import main_text

TEXT = "The first paragraph has a good number of words, some commas, and a point to make about rivers."
MORE = "The second one goes on for a while, as paragraphs do, and says what the first one left out."
LAST = "A third paragraph closes the story, with thanks, regrets, and a promise to write again soon."


def page(inside, head="", tail=""):
    return f"<html><body>{head}<article><h1>Rivers</h1><p>{TEXT}</p>{inside}<p>{LAST}</p></article>{tail}</body></html>"


@pytest.mark.parametrize("inside", [
    f'<p class="alert">{MORE}</p>', f'<section id="legal"><p>{MORE}</p></section>',
    f'<section id="related-work"><p>{MORE}</p></section>', f'<div class="search-results"><p>{MORE}</p></div>',
    f"<p><label>{MORE}</label></p>", f'<div class="notice">{MORE}</div>', f'<p title=it\'s>{MORE}</p>',
    f'<p title="a > b" data-x=\'c > d\'>{MORE}</p>', f"<p a=b=c 'x' \"y\">{MORE}</p>",
])
def test_parts_of_an_article_stay(inside):
    assert main_text(page(inside)) == f"Rivers {TEXT} {MORE} {LAST}"


@pytest.mark.parametrize("inside", [
    '<div class="share">Share this: <a href="#">Mail</a></div>', '<div class="ad-box">Buy now, cheap, today only, hurry!</div>',
    '<div class="related">Related: <a href="1">One more story about rivers</a> <a href="2">Another story</a></div>',
    '<form><label>Your name</label><input name="n"><p>Leave your name here, and your address, if you like.</p></form>',
    '<div class="comments"><p>What a fine article, I read it twice, and then again.</p></div>',
    '<nav>Home, News, Sport</nav>', '<div style="display: none">Hidden words, never shown, not even once.</div>',
])
def test_what_is_not_the_article_goes(inside):
    assert main_text(page(inside)) == f"Rivers {TEXT} {LAST}"


def test_a_form_around_the_page_is_a_wrapper():
    inner = f'<input type="hidden" name="state"><div id="main"><p>{TEXT}</p><p>{MORE}</p><p>{LAST}</p></div><button>Send</button>'
    assert main_text(f'<html><body><form id="aspnetForm" method="post">{inner}</form></body></html>') == f"{TEXT} {MORE} {LAST}"
    assert main_text("<html><body><form><label>Name</label><input><button>Log in</button></form></body></html>") == ""


def test_unclosed_things():
    assert main_text(page("") + "<!-- to the end <p>not this") == f"Rivers {TEXT} {LAST}"
    assert main_text(f"<article><p>{TEXT}</p><p>{MORE}</p></article><p title='") .startswith(f"{TEXT} {MORE}")


def test_time_is_linear_in_odd_tags():
    def took(n):
        start = time.perf_counter()
        main_text(page("<p title=it's>word, word</p>" * n + "<a " * n + '<b c="' * 2))
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 12 * took(2_000) + 0.5
