"""Pages of common layouts, made of parts written by hand: an article of two lengths under many kinds of wrapper.

Each is (name, html, text). Wrappers carry words that elsewhere mean a menu, a sidebar or comments, or are forms.
"""

_SHORT = ("The tram line", ["The city opened the first part of its new tram line on Monday morning.", "Trams run every ten minutes from the harbour to the old market, and the ride takes a quarter of an hour.", "Work on the second part begins in spring."])
_LONG = (
    "A winter on the island",
    [f"In the {n} week we {a}, and the keeper wrote it into the book that lies beside the lamp. {b}" for n, a, b in zip(
        "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(),
        ("mended the roof", "brought in the boats", "counted the sheep", "lost the anchor", "found the well frozen", "baked with the last flour", "heard the horn at night", "saw the lights of a ship", "dug a path to the pier", "burned the old mast", "waited for the post", "painted the door"),
        ("Nobody had slept.", "The wind came from the north, as it does every year at this time.", "It was quiet after that, for three days or so.", "We said little.", "There was bread, cheese and tea enough for all of us until the end of the month.", "The dog stayed by the stove.") * 2, strict=True)],
)
_NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul></nav>"
_SIDE = "<aside class=sidebar><h3>Most read</h3><ul><li><a href=1>Bridge closed</a></li><li><a href=2>New school</a></li></ul></aside>"
_FOOT = "<footer><p>&copy; 2024 The Courier. All rights reserved.</p></footer>"
_COMMENTS = "<section class=comments><h3>2 comments</h3><div class=comment><p>At last, I have waited for this for years!</p></div><div class=comment><p>Too late and too dear, if you ask me.</p></div></section>"

_WRAPPERS = (
    "layout has-sidebar", "post comments-open", "modal-enabled", "main-header-layout", "story ad-free", "page-menu-left", "no-sidebar page", "with-banner", "site header-fixed", "wrap cookie-accepted", "footer-wide",
    "newsletter-active", "is-popup-closed", "nav-open", "social-enabled site", "has-related", "breadcrumb-on", "tags-visible page", "login-required", "promo-free", "reply-enabled", "single-post sidebar-right", "toolbar-fixed", "share-enabled",
)


def _body(title: str, lines: list[str]) -> str:
    return f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in lines)


def _pages():
    for size, (title, lines) in (("short", _SHORT), ("long", _LONG)):
        text, body = "\n".join([title, *lines]), _body(title, lines)
        whole = f"{_NAV}<div class=content>{body}</div>{_SIDE}{_COMMENTS}{_FOOT}"
        page = "<html><head><title>t</title></head><body>{}</body></html>"
        for name in _WRAPPERS:
            yield f"{size} {name}", page.format(f'<div class="{name}">{whole}</div>'), text
        yield f"{size} form", page.format(f"<form id=aspnetForm method=post>{whole}</form>"), text
        yield f"{size} form and article", page.format(f"<form id=form1 action=x.aspx><input type=hidden>{_NAV}<article>{body}</article>{_FOOT}</form>"), text
        yield f"{size} form inside", page.format(f"<div id=page><form method=post>{_NAV}<div id=main>{body}</div>{_SIDE}</form>{_FOOT}</div>"), text
        yield f"{size} links", page.format(f"{_NAV}<article><h1>{title}</h1>" + "".join(f"<p><a href=/{k}>{x}</a></p>" for k, x in enumerate(lines)) + f"</article>{_SIDE}{_FOOT}"), text
        yield f"{size} list", page.format(f"{_NAV}<main><h1>{title}</h1><ul>" + "".join(f"<li>{x}</li>" for x in lines) + f"</ul></main>{_SIDE}{_FOOT}"), text
        yield f"{size} numbered list", page.format(f"<div class=wrap>{_NAV}<div class=post><h1>{title}</h1><ol>" + "".join(f"<li>{x}" for x in lines) + f"</ol></div>{_COMMENTS}</div>{_FOOT}"), text
        yield f"{size} table", page.format(f"<table width=100%><tr><td class=menu>{_NAV}</td><td>{body}</td><td>{_SIDE}</td></tr></table>{_FOOT}"), text
        yield f"{size} two wrappers", page.format(f'<div class="has-sidebar"><div class="comments-open site">{whole}</div></div>'), text
        yield f"{size} plain", page.format(f"<div class=wrap>{whole}</div>"), text


LAYOUTS = list(_pages())
