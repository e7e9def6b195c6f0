"""Hand-labelled pages that the weights of main-text extraction are learnt from: the article lies between {{ and }}."""

_SAID = (
    "The river had risen all night, and by morning the lower fields were under water.",
    "Nobody in the village could remember a flood like it, although the old mill carried marks of three of them.",
    "We walked along the dam with the engineer, who counted the sandbags and wrote the number down.",
    "Most of the families had gone to the school on the hill, where soup was handed out.",
    "In the evening the rain stopped; the stars came out, and the water began to fall.",
    "What remained was mud, and a great deal of work for the next weeks.",
)


def _said(*which: int) -> str:
    return " ".join(_SAID[k] for k in which)


_LINKS = "".join(f'<li><a href="/{w.lower()}">{w}</a></li>' for w in ("Home", "World", "Sport", "Culture", "Weather", "Contact"))
_PARAGRAPHS = f"<h1>The flood</h1><p>{_said(0, 1)}</p><p>{_said(2)} <a href='/dam'>More on the dam</a>. {_said(3)}</p><h2>After the rain</h2><p>{_said(4, 5)}</p><p>It was <b>Monday</b>, the <em>third</em> of <i>May</i>, <strong>noon</strong>, as the <span>clock</span> <u>said</u>.</p>"
_CELLS = f"<table><thead><tr><th>Day</th><th>Level</th></tr></thead><tbody><tr><td>Monday</td><td>{_said(0)}</td></tr><tr><td>Tuesday</td><td>{_said(4)}</td></tr></tbody></table>"
_LIST = f"<h3>The dam</h3><ul><li>{_said(2)}</li><li>{_said(3)}</li></ul><ol><li><p>{_said(4)}</p></li></ol><dl><dt>Dam</dt><dd>{_said(2)}</dd></dl>"
_QUOTED = f"<blockquote><p>{_said(1)}</p></blockquote><pre><code>level = 3</code></pre><figure><img src='a.png'><figcaption>{_said(4)}</figcaption></figure>"


def _page(before: str, content: str, after: str, around: str = "body", attributes: str = "") -> str:
    return f"<html><head><title>The flood</title><script>var a = 1;</script></head><body {attributes}>{before}<{around}>{{{{{content}}}}}</{around.split()[0]}>{after}</body></html>"


_COMMENTS = "<div class='{0}'><h3>Comments</h3><ol class='{0}-list'><li class='{0}'><p>I remember the flood well, thank you for writing this.</p></li><li class='{0}'><p>Me too.</p><a href='#'>Reply</a></li></ol></div>"

PAGES = (
    # with an element that marks the article
    _page(f"<header><a href='/'>The Valley Post</a></header><nav><ul>{_LINKS}</ul></nav>", _PARAGRAPHS, f"<aside class='sidebar'><h3>Most read</h3><ul>{_LINKS}</ul></aside><footer>Copyright The Valley Post. All rights reserved.</footer>", "article", "class='has-sidebar'"),
    _page(f"<ul class='menu'>{_LINKS}</ul>", f"<div><div>{_said(0)}</div><div>{_said(1)}</div></div><section><div><p>{_said(2)}</p></div>{_QUOTED}</section>", "<footer>Imprint</footer>", "article"),
    _page(f"<div class='topbar'><a href='/login'>Log in</a></div><nav class='navbar main-nav'><ul>{_LINKS}</ul></nav><div class='ad'>Buy new boots now.</div>", _PARAGRAPHS + _LIST, "<section class='related'><article><h3>A new bridge</h3><p>The council decided.</p></article><article><h3>Old mills</h3><p>A walk in spring.</p></article></section>" + _COMMENTS.format("comments"), "article class='post'"),
    _page("<header class='masthead'><h2>Notes from the hills</h2></header>", _PARAGRAPHS + "}}<div class='ad ad-slot'><p>Our sponsor sells umbrellas for every weather.</p></div>{{" + _CELLS + _QUOTED, "<footer class='footer'><p>Written in the hills.</p></footer>", "main id='content'"),
    _page("<div id='cookie-notice' class='cookie-banner'><p>We use cookies to give you the best experience.</p><button>Accept</button></div>", "}}<header><p class='byline'>By our reporter, 3 May</p></header>{{" + _PARAGRAPHS + "}}<aside><p>Read our newsletter.</p></aside>{{" + _QUOTED + "}}<footer><p>Tags: rain, river</p></footer>{{", "<div class='newsletter-signup'><form><p>Get our letter every week.</p><input name=q></form></div><footer>Imprint</footer>", "article class='story'"),
    _page(f"<div class='page-wrapper layout'><div class='sidebar'><ul class='menu'>{_LINKS}</ul></div>", _PARAGRAPHS, "</div>" + _COMMENTS.format("comment"), "article"),
    # without one
    _page(f"<div id='header'><h2>The Valley Post</h2></div><ul class='nav'>{_LINKS}</ul><div class='breadcrumbs'><a href='/'>Home</a> <a href='/world'>World</a></div>", _PARAGRAPHS + _LIST, f"<div class='sidebar widget'><h3>Archive</h3><ul>{_LINKS}</ul></div><div id='footer'>Copyright The Valley Post. <a href='/terms'>Terms</a></div>", "div class='content main-content'", "class='layout'"),
    _page(f"<div class='navigation'>{_LINKS}</div><div class='ads'><p>Boots, half price this week.</p></div>", _PARAGRAPHS + _CELLS, f"<div class='related-posts'><h3>Related posts</h3><ul>{_LINKS}</ul></div>" + _COMMENTS.format("comments"), "div id='post' class='entry post-body'"),
    _page("<div class='notice'><p>Our shop is closed on Monday.</p></div><form class='search-form'><p>Search the site</p></form>", _PARAGRAPHS, "<div class='share social'><a href='#'>Share</a> <a href='#'>Print</a></div><div class='pagination'><a href='/2'>Next page</a></div>", "section class='story text'", "class='has-sidebar page'"),
    _page(f"<table class='menubar'><tr><td>{_LINKS}</td></tr></table>", "<table><tbody><tr><td>" + _PARAGRAPHS + "</td></tr></tbody></table>" + _CELLS, "<div class='disclaimer legal'><p>No warranty is given for anything on this page.</p></div><div class='copyright'>Copyright 2011</div>", "div"),
    _page("<div class='gdpr-consent popup'><p>We value your privacy and ask for your consent.</p></div><div class='skip-link'><a href='#main'>Skip to the text</a></div>", "<h1>The flood</h1>" + _QUOTED + f"<p>{_said(0)}<br>{_said(1)}</p><div><p>{_said(2)}</p></div><div>{_said(3)}</div>", f"<div class='trending'><h3>Trending</h3><ul>{_LINKS}</ul></div><div class='newsletter subscribe'><p>Subscribe to our letter.</p></div>", "div role='main' class='wrapper inner'"),
    _page(f"<div class='sponsored promo'><p>Sponsored: see the world by train.</p></div><div class='menu dropdown-menu'>{_LINKS}</div>", f"<p>{_said(0)}</p><p>{_said(1)}</p><p>{_said(2, 3)}</p><p>{_said(4)}</p>" + _LIST, "<div class='advert advertisement banner'><p>A word from our sponsor.</p></div><div class='teaser recommended'><h3>Read on</h3><p>A new bridge.</p></div><div style='display:none'>tracker</div>", "div class='article-text body'"),
    _page("<div class='alert warning'><p>You use an old browser.</p></div><div class='login modal'><p>Log in to read on.</p></div>", _PARAGRAPHS, "<div class='replies reply'><p>Nice one.</p><a href='#'>Reply</a></div><div hidden>Saved.</div><div aria-hidden='true'>x</div>", "section id='section' class='container grid'"),
    _page(f"<div class='widget widget-area'>{_LINKS}</div><div class='overlay'><p>Allow notifications.</p></div>", "<div class='row column'>" + _PARAGRAPHS + "</div>", "<div class='sponsor'><p>With thanks to our sponsor.</p></div><div class='outbrain taboola'><p>Ten foods that doctors avoid.</p></div><div class='comment-form respond'><p>Leave a reply</p></div>", "div class='box block panel area'"),
    _page("<div class='consent notice cookies'><p>This site uses cookies.</p></div>", _PARAGRAPHS, "<div class='bottom footer-links'><a href='/imprint'>Imprint</a></div><div class='cookie notice notification'><p>We changed our terms.</p></div><menu><li>Cut</li></menu><dialog>Sure?</dialog><fieldset><p>Your name</p></fieldset>", "div class='page section content-area'"),
    _page(f"<div>{_LINKS}</div><p>The Valley Post</p><div><span><a href='/login'>Log in</a></span> <span><a href='/help'>Help</a></span></div>", _PARAGRAPHS + _LIST, "<div><a href='/a'>Next</a> <a href='/b'>Back</a></div><div><p>Copyright 2011</p><p><a href='/terms'>Terms</a></p></div>", "div"),
    _page(f"<div class='page-header nav-wrapper'><div class='container'>{_LINKS}</div></div><div class='ad-box'><p>Half price boots.</p></div><div class='promo-block ad-container'><p>Trains to the sea.</p></div>", _PARAGRAPHS, f"<div class='widget-panel grid'><div class='menu-row'>{_LINKS}</div></div><div class='footer-container page-footer'><div class='footer-inner row column'>Copyright</div></div><div class='comment-section section'><p>I was there too.</p></div>", "div class='post'"),
    _page(f"<p><a href='/'>Home</a></p><ul>{_LINKS}</ul><div class='sidebar-inner box block'><ul>{_LINKS}</ul></div>", f"<p>{_said(0, 1)}</p>" + _CELLS + f"<p>{_said(2, 3, 4)}</p>", "<p>Last change: 3 May</p><ul><li><a href='/imprint'>Imprint</a></li><li><a href='/jobs'>Jobs</a></li></ul><div class='ad-wrapper area panel'><p>Buy now.</p></div>", "div"),
)
