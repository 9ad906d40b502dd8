"""Labelled pages that the extraction model is trained on.

Pages are put together from layouts: each layout nests parts the way sites do, and each part is main
text or not. ``data-main`` on an element labels it and all below it. Texts are invented; their
lengths and the number of links vary with the page number, so that no two pages are alike.
"""

from __future__ import annotations

WORDS = (
    "river stone light early winter market people council report number season garden letter music answer"
    " north small public road water paper history morning question village school change music story travel"
).split()


def _text(n: int, seed: int) -> str:
    words = [WORDS[(seed * 7 + i * (3 + seed % 5) + i * i) % len(WORDS)] for i in range(n)]
    for i in range(9, n, 11):
        words[i] += "."
    return " ".join(words).capitalize() + "."


def _links(n: int, seed: int) -> str:
    return "".join(f'<li><a href="/{i}">{_text(1 + (seed + i) % 2, seed + i)[:-1]}</a></li>' for i in range(n))


#: Words of paragraphs: articles hold one-word lines as well as long paragraphs.
LENGTHS = (1, 60, 2, 25, 1, 100, 3, 40, 2, 15, 200, 5, 1, 30, 8, 80)


def _paragraphs(n: int, seed: int) -> str:
    parts = []
    for i in range(n):
        length = LENGTHS[(seed * 5 + i * 7 + i * i) % len(LENGTHS)]
        body = _text(length, seed + i)
        kind = (seed + i) % 9
        if kind == 3:
            body = f"<b>{body}</b> {_text(5, i)}"
        if kind == 4:
            body = f'{body} <a href="/x">{_text(3, i)}</a> {_text(8, i)}'
        if kind == 5:
            parts.append(f"<h2>{_text(4, seed + i)[:-1]}</h2>")
        if kind == 6:
            parts.append(f"<ul><li>{_text(7, seed)}</li><li>{_text(9, i)}</li></ul>")
        if kind == 7:
            parts.append(f"<blockquote>{_text(16, i)}</blockquote>")
        parts.append(f"<p>{body}</p>")
    return "".join(parts)


def _noise(seed: int) -> dict[str, str]:
    n = 3 + seed % 6
    return {
        "nav": [
            f"<nav><ul>{_links(n, seed)}</ul></nav>",
            f'<div class="menu"><ul>{_links(n, seed)}</ul></div>',
            f'<ul id="navigation" class="navbar">{_links(n, seed)}</ul>',
            f'<div id="breadcrumb"><a href="/">{_text(1, seed)}</a> &gt; <a href="/a">{_text(1, seed + 1)}</a></div>',
        ][seed % 4],
        "header": [
            f"<header><h1>{_text(2, seed)[:-1]}</h1><p>{_text(6, seed)}</p></header>",
            f'<div id="header" class="masthead"><a href="/">{_text(2, seed)}</a></div>',
            f'<header class="site-header"><a class="logo" href="/">{_text(2, seed)}</a><form><input name="q"></form></header>',
        ][seed % 3],
        "footer": [
            f"<footer>&copy; {_text(4 + seed % 9, seed)}</footer>",
            f'<div class="footer"><p>{_text(8, seed)}</p><ul>{_links(3, seed)}</ul></div>',
            f"<footer><p>&copy; 2020 {_text(2, seed)}</p><p>{_text(14, seed)}</p></footer>",
        ][seed % 3],
        "side": [
            f"<aside><h3>{_text(2, seed)[:-1]}</h3><ul>{_links(n, seed)}</ul><p>{_text(18, seed)}</p></aside>",
            f'<div class="sidebar"><h4>{_text(2, seed)[:-1]}</h4><p>{_text(22, seed)}</p></div>',
            f'<div id="related" class="widget"><ul>{_links(n, seed)}</ul></div>',
        ][seed % 3],
        "ad": [
            f'<div class="ad">{_text(6 + seed % 15, seed)}</div>',
            f'<div class="advert banner"><p>{_text(9 + seed % 9, seed)}</p></div>',
            f'<section class="sponsored promo"><a href="/s">{_text(5, seed)}</a><p>{_text(12, seed)}</p></section>',
        ][seed % 3],
        "notice": [
            f'<div class="cookie-notice"><p>{_text(20, seed)}</p><button>{_text(1, seed)}</button></div>',
            f'<div id="consent" role="dialog">{_text(16, seed)}<button>{_text(2, seed)}</button></div>',
            f'<div class="newsletter subscribe"><p>{_text(10, seed)}</p><form><label>{_text(2, seed)}</label><input></form></div>',
        ][seed % 3],
        "form": [
            f"<form><label>{_text(3, seed)}</label><input><select><option>{_text(1, seed)}</option></select><button>{_text(1, seed)}</button></form>",
            f'<form class="search"><input name="q"><button>{_text(1, seed)}</button></form>',
        ][seed % 2],
        "comments": [
            f'<section id="comments"><h3>{_text(1, seed)[:-1]}</h3><div class="comment"><p>{_text(25, seed)}</p></div><div class="comment"><p>{_text(30, seed + 1)}</p></div></section>',
            f'<div class="comments"><ol><li class="comment reply"><p>{_text(28, seed)}</p></li></ol></div>',
            f'<div id="disqus-thread" class="responses"><p>{_text(24, seed)}</p></div>',
        ][seed % 3],
    }


def page(seed: int) -> str:
    x = _noise(seed)
    head = f"<!DOCTYPE html><html><head><title>{_text(4, seed)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    title, body = f"<h1>{_text(4, seed)[:-1]}</h1>", _paragraphs(1 + seed * seed % 17, seed)
    lead = f"<p><b>{_text(25, seed)}<br>" if seed % 3 == 0 else ""
    main = title + lead + body
    share = f'<div class="share social"><a href="/t">{_text(1, seed)}</a> <a href="/f">{_text(1, seed)}</a></div>'
    nested = f"{title}<section><h2>{_text(3, seed)[:-1]}</h2>{body}</section><section><div>{_paragraphs(3, seed + 1)}</div></section>"
    mixed = f"{lead}<div>{body}</div><div class='share social' data-other>{_links(2, seed)}</div>{_paragraphs(2, seed + 3)}"
    brief = f"{title}<p>{_text(LENGTHS[seed % len(LENGTHS)], seed)}</p>"
    one_word = f"<h1>{_text(1, seed)}</h1><p>{_text(1, seed)}"
    layouts = [
        f"{x['nav']}{x['ad']}<article data-main>{one_word}</article>{x['footer']}",
        f"{x['nav']}{x['header']}<article data-main>{one_word}</article>{x['ad']}{x['footer']}",
        f"{x['nav']}{x['ad']}<article data-main>{brief}</article>{x['footer']}",
        f"{x['header']}{x['nav']}<main data-main>{brief}</main>{x['side']}{x['footer']}",
        f"{x['notice']}{x['header']}<article class='post' data-main>{main}</article>{x['comments']}{x['footer']}",
        f"{x['nav']}{x['ad']}<article data-main>{nested}</article>{x['footer']}",
        f"{x['header']}<div class='story' data-main>{title}{mixed}</div>{x['side']}{x['comments']}{x['footer']}",
        f"{x['nav']}<!-- x -->{x['ad']}<article data-main>{main}</article>{x['footer']}",
        f"{x['header']}{x['nav']}<main><article data-main>{main}</article>{x['side']}</main>{x['footer']}",
        f"{x['notice']}{x['header']}<div id='content'><div class='post' data-main>{main}</div>{x['comments']}</div>{x['side']}{x['footer']}",
        f"{x['nav']}<div class='container'><div class='row'><div class='article-body' data-main>{main}</div>{x['side']}</div></div>{x['comments']}{x['footer']}",
        f"{x['header']}<main data-main>{main}</main>{x['form']}{x['ad']}{x['footer']}",
        f"<div id='wrapper'>{x['header']}{x['nav']}<div id='main'><section class='entry' data-main>{main}</section>{x['comments']}{x['form']}</div>{x['footer']}</div>",
        f"{x['nav']}<article><div class='text' data-main>{main}</div>{share}{x['comments']}{x['ad']}</article>{x['footer']}",
        f"{x['header']}{x['nav']}<article><header class='entry-header' data-main>{title}</header><div class='entry-content' data-main>{body}</div>{x['side']}</article>{x['notice']}{x['footer']}",
        f"{x['nav']}<table><tr><td>{x['side']}</td><td class='content' data-main>{main}</td></tr></table>{x['footer']}",
        f"{x['nav']}{x['ad']}<div><div data-main>{main}</div><div>{x['ad']}</div></div>{x['form']}{x['footer']}",
    ]
    return head + layouts[seed % len(layouts)] + ("</body></html>" if seed % 4 else "")


def labelled_pages(n: int = 480) -> list[str]:
    return [page(seed) for seed in range(n)]
