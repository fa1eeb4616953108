"""Pages written by hand in the manner of common content systems, with the main text a reader would name.

Each entry is (name, body, blocks of the main text). Nothing here comes from the generator of training pages.
"""

P1 = "The river rose three metres overnight, and by morning the lower town was cut off from the station."
P2 = "Volunteers carried sandbags along the quay until the water began to fall, shortly after noon on Tuesday."
P3 = "Engineers say the old weir held because it was rebuilt in 1998; nobody expected it to be tested so soon."
P4 = "Insurance assessors will visit the affected streets this week, starting with the market square."
P5 = "Mix the flour with the salt, rub in the butter, and add just enough cold water to bring it together."
P6 = "Let the dough rest for thirty minutes before rolling it out, otherwise it will shrink in the oven."
P7 = "Bees do not see red, which is why red flowers pollinated by insects usually reflect ultraviolet light."
P8 = "In the second experiment we trained the animals on four colours and tested them on eight."

GOLD: list[tuple[str, str, list[str]]] = [
    ("wordpress", f"""<body class="post-template-default single"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Valley News</a></p>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header>
<main id="main" class="site-main"><article id="post-41" class="post-41 post type-post hentry"><header class="entry-header"><h1 class="entry-title">Flood closes the lower town</h1></header>
<div class="entry-content"><p>{P1}</p><p>{P2}</p><div class="sharedaddy sd-sharing-enabled"><div class="robots-nocontent sd-block"><h3 class="sd-title">Share this:</h3><ul><li><a href="#">Twitter</a></li><li><a href="#">Facebook</a></li></ul></div></div></div>
<footer class="entry-footer"><span class="cat-links">Posted in <a href="/c">Local</a></span></footer></article>
<section id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment even"><article class="comment-body"><footer class="comment-meta"><b class="fn">Ann</b></footer><div class="comment-content"><p>We were out all night, thank you to everybody who helped us.</p></div></article></li></ol></section></main>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>Recent Posts</h2><ul><li><a href="/x">Council votes</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by WordPress</div></footer></div></body>""", ["Flood closes the lower town", P1, P2]),
    ("sharedaddy", f"""<body><div class="sharedaddy">Share this</div><article><h1>Pastry</h1><p>{P5}</p><p>{P6}</p></article></body>""", ["Pastry", P5, P6]),
    ("misleading container", f"""<body><nav><a href="/">Start</a> <a href="/b">Boards</a></nav><div class="notice-board-history"><h1>A history of the notice board</h1><p class="tags-explained">{P7}</p><p>{P8}</p></div><footer>© 2021 Museum of Paper</footer></body>""", ["A history of the notice board", P7, P8]),
    ("article header", f"""<body><header><a href="/">The Gazette</a></header><article><header><h1>Real title</h1></header><p>{P3}</p><p>{P4}</p></article></body>""", ["Real title", P3, P4]),
    ("opaque names", f"""<body><div class="x9f2"><div class="a0k"><a href="/">Home</a><a href="/news">News</a><a href="/sport">Sport</a></div><div class="q7"><h1>Weir holds</h1><p>{P1}</p><p>{P3}</p><p>{P4}</p></div><div class="zz8">Copyright 2023 Valley Media. All rights reserved.</div></div></body>""", ["Weir holds", P1, P3, P4]),
    ("plain html", f"""<body><h1>Notes on colour</h1><p>{P7}<p>{P8}</body>""", ["Notes on colour", P7, P8]),
    ("medium", f"""<body><div id="root"><div class="a b c"><nav class="s u"><a href="/">Medium</a><a href="/signin">Sign in</a></nav></div><article><div class="l"><section><h1 class="pw-post-title gh">How bees see</h1><p class="pw-post-body-paragraph fo">{P7}</p><p class="pw-post-body-paragraph fo">{P8}</p></section></div></article><div class="ab ca"><h2>More from Ann Lee</h2><div><a href="/1">Why wasps matter</a></div><div><a href="/2">Ants at work</a></div></div></div></body>""", ["How bees see", P7, P8]),
    ("drupal", f"""<body class="node-type-story"><div id="skip-link"><a href="#main">Skip to main content</a></div><div class="region region-header"><div id="block-branding">River Trust</div></div><div class="region region-content"><article class="node node--type-story"><h2 class="title">Quay reopened</h2><div class="field field--name-body"><p>{P2}</p><p>{P4}</p></div><ul class="links inline"><li><a href="/user/login">Log in</a> to post comments</li></ul></article></div><footer class="region region-footer"><p>Registered charity 1098</p></footer></body>""", ["Quay reopened", P2, P4]),
    ("blogger", f"""<body><div class="header section" id="header"><h1 class="title">Kitchen diary</h1></div><div class="post hentry"><h3 class="post-title entry-title">Short pastry</h3><div class="post-body entry-content"><p>{P5}</p>{P6}<br><br>{P4}</div><div class="post-footer">Posted by Mo at <a href="/p">10:12</a></div></div><div class="comments" id="comments"><h4>3 comments:</h4><p>Tried it, lovely.</p></div></body>""", ["Short pastry", P5, f"{P6} {P4}"]),
    ("docs", f"""<body><div class="sphinxsidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div><div class="document"><div class="body" role="main"><section id="use"><h1>Use</h1><p>{P8}</p><pre>run --all</pre><h2>Options</h2><ul><li><p>--all runs everything</p></li><li><p>--one runs one</p></li></ul></section></div></div><div class="footer">© Copyright 2020, the authors.</div></body>""", ["Use", P8, "run --all", "Options", "--all runs everything", "--one runs one"]),
    ("newspaper", f"""<body><header class="masthead"><a href="/">Daily</a></header><div class="ad-slot ad-top"><span>Advertisement</span></div><main><article class="story"><h1>Assessors arrive</h1><p class="byline">By Jo Park</p><p>{P4}</p><aside class="related-stories"><h3>Related</h3><a href="/r">Flood in pictures</a></aside><p>{P1}</p><div class="newsletter-signup"><h3>Sign up for our newsletter</h3><form><input><button>Go</button></form></div><p>{P2}</p></article></main><footer>Terms of use</footer></body>""", ["Assessors arrive", "By Jo Park", P4, P1, P2]),
    ("cookie banner", f"""<body><div id="cookie-consent" role="dialog"><p>We use cookies to improve your visit. By continuing you accept our policy.</p><button>Accept</button></div><main><h1>Dough</h1><p>{P6}</p></main></body>""", ["Dough", P6]),
    ("table of figures", f"""<body><article><h1>Levels</h1><p>{P1}</p><table><tr><th>Day</th><th>Metres</th></tr><tr><td>Monday</td><td>1.2</td></tr><tr><td>Tuesday</td><td>4.3</td></tr></table></article><nav class="pager"><a href="/1">Previous</a><a href="/3">Next</a></nav></body>""", ["Levels", P1, "Day", "Metres", "Monday", "1.2", "Tuesday", "4.3"]),
    ("figure", f"""<body><article><h1>Ultraviolet</h1><figure><img src="a.jpg"><figcaption>A poppy under ultraviolet light.</figcaption></figure><p>{P7}</p></article></body>""", ["Ultraviolet", "A poppy under ultraviolet light.", P7]),
    ("links in prose", f"""<body><ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/s">Science</a></li></ul><div class="content"><h1>Sources</h1><p>The <a href="/1">first study</a>, the <a href="/2">second study</a> and a <a href="/3">long review</a> disagree on this point.</p><p>{P8}</p></div></body>""", ["Sources", "The first study, the second study and a long review disagree on this point.", P8]),
    ("share between", f"""<body><article class="post"><h1>Sandbags</h1><div class="social-share"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{P2}</p><p>{P3}</p></article></body>""", ["Sandbags", P2, P3]),
    ("comments without names", f"""<body><article><h1>Rest the dough</h1><p>{P6}</p><p>{P5}</p></article><div class="k3v"><h3>4 comments</h3><div class="k3w"><p>Thank you, this worked the first time I tried it.</p></div><div class="k3w"><p>Mine shrank anyway.</p></div></div></body>""", ["Rest the dough", P6, P5]),
    ("ghost", f"""<body><div class="viewport"><header id="gh-head" class="gh-head"><nav><a href="/">Notebook</a></nav></header><main id="site-main"><article class="article post"><header class="article-header gh-canvas"><h1 class="article-title">Four colours</h1><p class="article-excerpt">What the second experiment showed.</p></header><section class="gh-content gh-canvas"><p>{P8}</p><p>{P7}</p></section></article></main><footer class="site-footer outer"><section class="copyright">Notebook © 2022</section></footer></div></body>""", ["Four colours", "What the second experiment showed.", P8, P7]),
    ("wikipedia", f"""<body><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">Weir</h1><div id="bodyContent"><div id="mw-content-text"><p>{P3}</p><h2>Use</h2><p>{P1}</p></div></div></div><div id="mw-navigation"><h2>Navigation menu</h2><ul><li><a href="/m">Main page</a></li><li><a href="/c">Contents</a></li></ul></div><div id="footer" role="contentinfo"><ul><li>Text is available under a licence; additional terms may apply.</li></ul></div></body>""", ["Weir", P3, "Use", P1]),
    ("definition list", f"""<body><main><h1>Terms</h1><p>{P8}</p><dl><dt>Weir</dt><dd>A low dam across a river.</dd><dt>Quay</dt><dd>A place where boats load.</dd></dl></main></body>""", ["Terms", P8, "Weir", "A low dam across a river.", "Quay", "A place where boats load."]),
    ("quote", f"""<body><article><h1>What she said</h1><p>{P1}</p><blockquote><p>We had never seen it so high, not even in my grandmother's stories.</p></blockquote><p>{P4}</p></article></body>""", ["What she said", P1, "We had never seen it so high, not even in my grandmother's stories.", P4]),
    ("entities", """<body><article><h1>Fish &amp; chips</h1><p>Caf&eacute; prices rose by 5&nbsp;% &mdash; again, the owners say, because of the cost of oil and potatoes.</p></article></body>""", ["Fish & chips", "Café prices rose by 5 % — again, the owners say, because of the cost of oil and potatoes."]),
    ("hidden", f"""<body><article><h1>Visible</h1><p>{P2}</p></article><div style="display:none"><p>This text is not shown to anybody who reads the page.</p></div><div class="footer-links"><a href="/i">Imprint</a></div></body>""", ["Visible", P2]),
    ("menu of buttons", f"""<body><div class="toolbar"><button>Save</button><button>Print</button></div><div id="main-content"><h1>Checklist</h1><ol><li>Move the car to higher ground.</li><li>Turn off the electricity at the box.</li><li>Take the papers upstairs.</li></ol><p>{P4}</p></div></body>""", ["Checklist", "Move the car to higher ground.", "Turn off the electricity at the box.", "Take the papers upstairs.", P4]),
    ("section wrappers", f"""<body><div class="container"><div class="row"><div class="col-md-8"><article><section><h1>Two parts</h1><p>{P5}</p></section><section><h2>Second part</h2><p>{P6}</p></section></article></div><div class="col-md-4"><div class="sidebar"><h4>About us</h4><p>We write on food and rivers.</p></div></div></div></div></body>""", ["Two parts", P5, "Second part", P6]),
    ("related inside", f"""<body><main class="content"><h1>Market square</h1><p>{P4}</p><p>{P2}</p><div class="related-posts"><h3>You may also like</h3><ul><li><a href="/1">The old bridge</a></li><li><a href="/2">Floods of 1954</a></li></ul></div></main></body>""", ["Market square", P4, P2]),
    ("post names", f"""<body><div id="social-history-of-bread"><h1>A social history of bread</h1><p>{P5}</p><p>{P6}</p></div></body>""", ["A social history of bread", P5, P6]),
    ("login form", f"""<body><form class="login-form"><label>Name</label><input><label>Password</label><input type="password"><button>Log in</button></form><article><h1>Members</h1><p>{P3}</p></article></body>""", ["Members", P3]),
    ("scripts", f"""<head><title>x</title><script>var a = "<p>not text</p>";</script></head><body><noscript>Please enable scripts</noscript><article><h1>Clean</h1><p>{P8}</p><script>track()</script><style>p{{}}</style></article></body>""", ["Clean", P8]),
    ("disqus", f"""<body><article class="entry"><h1>Falling water</h1><p>{P2}</p><p>{P1}</p><div id="disqus_thread"><p>Please enable JavaScript to view the comments.</p></div></article></body>""", ["Falling water", P2, P1]),
    ("long list article", "<body><main><h1>Ten birds</h1>" + "".join(f"<h2>{n}</h2><p>The {n.lower()} is seen here from March to October, mostly near the reeds.</p>" for n in ("Heron", "Coot", "Teal", "Grebe")) + "</main><aside><h3>Newsletter</h3><p>Subscribe to get bird news.</p></aside></body>", ["Ten birds", *[x for n in ("Heron", "Coot", "Teal", "Grebe") for x in (n, f"The {n.lower()} is seen here from March to October, mostly near the reeds.")]]),
    ("opaque with share and comments", f"""<body><div class="_1a"><div class="_2b"><a href="/">Front</a> | <a href="/l">Local</a></div><div class="_3c"><h1>After the flood</h1><p>{P1}</p><p>{P2}</p><div class="_4d">Share <a href="#">Facebook</a> <a href="#">Twitter</a></div></div><div class="_5e"><h2>Comments</h2><div class="_6f"><b>Lee</b><p>Is the bus running again? I could not find anything.</p></div></div><div class="_7g">© 2024 Valley News</div></div></body>""", ["After the flood", P1, P2]),
    ("magazine", f"""<body><div class="site-top-banner"><a href="/offer">Half price this month</a></div><div class="post-wrapper"><div class="post-inner"><h1 class="headline">Red flowers</h1><p class="standfirst">Why insects pass them by, and which ones do not.</p><div class="article__body"><p>{P7}</p><div class="promo-box"><p>Listen to our podcast on insects.</p></div><p>{P8}</p></div></div></div></body>""", ["Red flowers", "Why insects pass them by, and which ones do not.", P7, P8]),
    ("nested comments in article", f"""<body><article class="post"><h1>Shrinking</h1><div class="entry"><p>{P6}</p></div><div class="post-comments"><h3>Comments</h3><ul><li class="comment">Great advice, many thanks. <ul class="children"><li class="comment">Agreed, it saved my pie.</li></ul></li></ul></div></article></body>""", ["Shrinking", P6]),
    ("empty page", "<body><nav><a href='/'>Home</a></nav><footer>© 2020</footer></body>", []),
]
