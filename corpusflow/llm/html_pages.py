"""Labelled pages from which the extractor learns its weights.

Each page is a small original example of a common layout; elements marked ``data-main``
hold main text, all other text is boilerplate. Callers can pass their own labelled pages.
"""

_LEAD = "Rain moved in over the valley before noon and the ferry stayed in port for the day."
_BODY = ("The harbour office said on Tuesday that two boats had come back early, and that nobody was hurt. "
         "Work on the north pier goes on next week, with a crew of twelve and a new crane from the yard.")
_MORE = "A short walk from the pier, the market hall opens at eight and closes when the last stall is sold out."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "About us", "Contact"))
_MAIN = f"<p data-main>{_LEAD}</p><h2 data-main>What comes next</h2><p data-main>{_BODY}</p><p data-main>{_MORE}</p>"
_TALK = "<p>I was there and the queue was very long.</p><p>Thanks for the report, see you on the pier!</p>"

LABELLED_PAGES: list[str] = [
    f"""<html><head><title>Ferry news</title><style>p{{color:red}}</style></head><body><header class="site-header"><div class="logo">
    Harbour Daily</div><nav><ul>{_LINKS}</ul></nav></header><main><article><header><h1 data-main>Ferry stays in port</h1></header>{_MAIN}
    <aside class="related"><h3>Related stories</h3><ul>{_LINKS}</ul></aside><p data-main>{_BODY}</p></article>
    <section id="comments" class="comments"><h2>Comments</h2>{_TALK}</section></main><aside class="sidebar"><h3>Most read</h3>
    <ul>{_LINKS}</ul></aside><footer><p>Harbour Daily, all rights reserved. Terms and privacy.</p></footer></body></html>""",
    f"""<html><body><div class="cookie-notice banner">We use cookies to make this site better. <button>Accept</button></div>
    <div id="menu" class="menu navigation"><ul>{_LINKS}</ul></div><div class="ad advert">Buy two pairs of boots and pay for one.</div>
    <div id="content" class="content"><h1 data-main>Ferry stays in port</h1>{_MAIN}<div class="ad">Visit the big spring sale today.</div>
    <blockquote data-main>{_LEAD}</blockquote></div><div class="comments" id="comments"><div class="comment">{_TALK}</div></div>
    <div id="footer" class="footer">Contact the editors by mail or phone.</div></body></html>""",
    f"""<html><body><nav><a href="/">Home</a> | <a href="/news">News</a></nav><article class="post entry"><h1 data-main>Ferry stays in port</h1>
    {_MAIN}<form class="newsletter subscribe"><label>Get our letter by mail</label><input name="m"><button>Send</button></form>
    <ul data-main><li>{_LEAD}</li><li>{_MORE}</li></ul><div class="share social">Share this page with your friends</div>
    <section class="comments responses"><h3>Reader comments</h3><article class="comment"><p>So true, we waited for hours.</p></article>
    </section><footer>Filed under boats by the desk</footer></article><div class="widget sidebar">Popular now <ul>{_LINKS}</ul></div><footer>Imprint and contact</footer></body></html>""",
    f"""<html><body><div class="header masthead topbar">Harbour Daily, the paper of the coast <a href="/login">Log in</a></div>
    <div class="breadcrumb breadcrumbs"><a href="/">Home</a> &gt; <a href="/news">News</a></div><div class="main"><div class="article body text">
    {_MAIN}</div></div><div class="sponsored promo promotion">Partner offer: a free night at the pier hotel.</div>
    <div class="pagination pager"><a href="?p=1">1</a> <a href="?p=2">2</a></div><div class="disqus discussion replies">{_TALK}</div>
    <div class="popup modal overlay consent gdpr">Please agree to our terms before you read on.</div></body></html>""",
    f"""<html><body><header><h2>Harbour Daily</h2><form class="search"><input name="q"> Search the site</form></header>
    <div class="notice alert warning">Maintenance tonight from ten to twelve.</div><main id="main" class="page"><h1 data-main>Ferry stays</h1>
    <section class="section story"><p data-main>{_LEAD}</p><figure><figcaption data-main>The ferry at the north pier</figcaption></figure>
    <p data-main>{_BODY}</p><table data-main><tr><td>Monday</td><td>no service</td></tr></table><pre data-main>08:00 north 09:30 south</pre></section>
    <div class="advertisement ads banner">Boots for every weather.</div></main><aside><h3>About the author</h3><p>Writes about boats.</p></aside>
    <footer class="footer"><div class="copyright legal">Copyright Harbour Daily</div><ul>{_LINKS}</ul></footer></body></html>""",
    f"""<html><body><div class="wrapper container"><div class="toolbar menu">{_LINKS}</div><div class="post content"><div class="entry">
    <p data-main>{_BODY}</p><p data-main>{_MORE}</p><p data-main>{_LEAD}</p><div class="related recommended">You may also like <ul>{_LINKS}</ul></div>
    <p data-main>{_BODY}</p></div></div><div class="sidebar aside">{_TALK}</div><div class="comment reply">First!</div></div></body></html>""",
]

_NOTE = "We use cookies to make this site better and to count visits. Read how in our privacy policy."
_CARD = '<article class="card teaser"><h3><a href="/n">A new crane for the yard</a></h3><p>The crane came by ship and took two days to build.</p></article>'
_AD = "Buy two pairs of boots and pay for one, this week only at the pier shop."

LABELLED_PAGES += [
    # a blog system: state classes on the body and the article, widgets beside it
    f"""<html><body class="single single-post has-sidebar with-comments logged-out"><div id="page" class="site"><header id="masthead" class="site-header">
    <nav id="site-navigation" class="main-navigation menu"><ul>{_LINKS}</ul></nav></header><div id="content" class="site-content"><main class="site-main">
    <article class="post type-post status-publish format-standard has-thumbnail hentry category-news tag-harbour tag-social"><header class="entry-header">
    <h1 class="entry-title" data-main>Ferry stays in port</h1><div class="entry-meta posted-on">Posted by admin on Monday</div></header>
    <div class="entry-content">{_MAIN}</div><footer class="entry-footer tags-links">Tagged harbour and ferry</footer></article>
    <div class="sharedaddy share-buttons social-share">Share this on your page</div><div class="post-navigation nav-links">Previous story and next story</div>
    <div id="comments" class="comments-area"><ol class="comment-list"><li class="comment">{_TALK}</li></ol><div id="respond" class="comment-respond">Leave a reply
    <form class="comment-form">Your mail will not be shown</form></div></div></main></div><aside id="secondary" class="widget-area sidebar">
    <section class="widget widget_recent_entries"><h2>Recent posts</h2><ul>{_LINKS}</ul></section></aside><footer id="colophon" class="site-footer">
    <div class="site-info">Proudly run by the harbour</div></footer></div></body></html>""",
    # a newsroom: sponsored boxes within the story, cards below it
    f"""<html><body class="page article-page"><div class="ad ad-top advertisement leaderboard">{_AD}</div><div class="c-header header__bar"><div class="logo">Daily</div>
    <ul class="nav menu-items">{_LINKS}</ul></div><div class="story story-body"><h1 data-main>Ferry stays in port</h1><div class="byline author-info">By our
    reporter, two minutes to read</div><p data-main>{_LEAD}</p><div class="inline-ad ad-slot advert">{_AD}</div><p data-main>{_BODY}</p>
    <form class="newsletter-signup newsletter promo">Get our letter by mail every day</form><p data-main>{_MORE}</p><div class="social share-tools">Share</div></div>
    <section class="latest related-stories"><h2>More from the coast</h2>{_CARD}{_CARD}</section><section class="most-read trending popular">{_CARD}</section>
    <div class="cookie-banner cookies consent notice">{_NOTE}</div><div class="footer footer-links legal">{_LINKS} All rights reserved</div></body></html>""",
    # one form around the whole page
    f"""<html><body><form id="aspnetForm" method="post"><div class="header banner"><a href="/">Harbour</a><div class="search-box">Search the site</div></div>
    <div class="breadcrumbs breadcrumb">You are here: <a href="/">Home</a> <a href="/n">News</a></div><table class="layout"><tr><td class="leftmenu menu">{_LINKS}</td>
    <td class="content-cell content"><div class="bodytext text">{_MAIN}<blockquote data-main>{_LEAD}</blockquote></div></td><td class="rightcol sidebar">{_AD}</td></tr>
    </table><div class="footer copyright">Imprint and contact. All rights reserved.</div></form></body></html>""",
    # a wiki and a manual: navigation boxes and notices around long text
    f"""<html><body class="mediawiki ltr"><div id="mw-navigation" class="navigation"><h2>Navigation menu</h2><ul>{_LINKS}</ul></div><div id="content" class="mw-body" role="main">
    <form role="search">Search this manual</form><div class="notice site-notice banner">Help to write this page and sign up today.</div><h1 id="firstHeading" data-main>Ferry</h1><div id="bodyContent"><div id="toc" class="toc">
    <h2>Contents</h2><ul>{_LINKS}</ul></div>{_MAIN}<section class="section reviews" data-main><h2>Reviews</h2><p>{_BODY}</p></section><p class="note notice" data-main>{_LEAD}</p>
    <section class="section related" data-main><h2>Related terms</h2><p>{_MORE}</p></section><div id="catlinks" class="catlinks tags">Categories: harbour, ferry</div></div></div>
    <div id="footer" role="contentinfo">This page was changed on Monday.<ul>{_LINKS}</ul></div></body></html>""",
    # a shop's guide page and a policy page: words of boilerplate as the topic
    f"""<html><body><div class="topbar alert announcement">Free shipping until Sunday</div><nav class="navbar nav-main"><ul>{_LINKS}</ul></nav><div class="container"><div class="row">
    <div class="col-md-8 main-column guide social-policy"><h1 data-main>Our rules on adverts</h1><p data-main>{_LEAD}</p><div class="review-text comment-rules" data-main><p>{_BODY}</p></div>
    <div class="print-version text-secondary" data-main><p>{_MORE}</p></div></div><div class="col-md-4 sidebar widget">{_AD}<div class="recommended related">{_CARD}</div></div></div></div>
    <form class="modal popup overlay subscribe-modal"><p>Subscribe now and get the first month free of charge.</p></form><div class="pagination pager">Page 1 of 3</div>
    <footer class="footer page-footer"><div class="social follow-us">Follow us</div>Terms and privacy</footer></body></html>""",
    # a magazine with the story in a section, and reader comments from a service
    f"""<html><body><div id="header" class="masthead toolbar">Coast Magazine <a href="/login" class="login">Log in</a></div><section class="feature body-copy"><h1 data-main>Ferry stays</h1>
    <p data-main>{_LEAD}</p><figure><figcaption data-main>The pier at noon</figcaption></figure><p data-main>{_BODY}</p><div class="pull-quote" data-main>{_MORE}</div>
    <div class="sponsored sponsor promo">{_AD}</div><p data-main>{_BODY}</p></section><div id="disqus_thread" class="discussion comments">{_TALK}{_TALK}</div><div class="tags tag-list">
    Filed under boats</div><div class="author-bio about-author">The author writes about boats and lives on the coast.</div><div class="gdpr cookie-consent popup">{_NOTE}</div>
    <div id="footer" class="colophon imprint">{_LINKS} Copyright Coast Magazine</div></body></html>""",
    # list pages and short pages
    f"""<html><body><nav>{_LINKS}</nav><main><h1 data-main>Ferry stays in port</h1><p data-main>{_LEAD}</p></main><section class="cards grid">{_CARD}{_CARD}{_CARD}</section>
    <form>Ask the editors about this story</form><aside class="promo">{_AD}</aside><footer>{_LINKS}</footer></body></html>""",
    f"""<html><body><div class="wrap"><div class="comments reader-comments feedback replies">{_TALK}{_TALK}{_TALK}</div><div class="text copy"><p data-main>{_LEAD}</p>
    <p data-main>{_BODY}</p></div><div class="share sharing social">Tell your friends</div><div class="sidebar rail">{_LINKS}{_AD}</div>
    <form class="newsletter subscribe signup">Our letter comes on Fridays</form><div class="menu submenu">{_LINKS}</div></div></body></html>""",
]
