"""The labelled table that the block classifier of ``html_text`` is trained on.

Each entry is a small page; a block that starts with ``+`` belongs to the main text, one that
starts with ``-`` doesn't (training takes the marks off). The pages are invented; they differ
in how they mark their parts: by element, by class, by role, or not at all.
"""

PAGES = [
    # a news page, everything by element
    """<body><nav><ul><li><a href="/">-Home</a></li><li><a href="/w">-World</a></li><li><a href="/s">-Sport and leisure</a></li></ul></nav>
    <div class="ad">-Buy two pairs of boots and the third pair is free until Sunday evening in all our shops.</div>
    <article><h1>+Harbour opens again</h1><p>+After three weeks of dredging the harbour opened to ferries on Tuesday, the port authority said in a short statement to the press.</p>
    <p>+Yes.</p><p>+Ferries will keep to the <a href="/t">winter timetable</a> until the end of March, and freight follows a week later.</p><p>+It rained.</p></article>
    <footer>-&copy; 2021 Harbour News. All rights reserved by the publisher and its licensors.</footer></body>""",
    # a blog, everything by class; a header in the article, comments as articles
    """<div id="header">-A gardener's notebook <a href="/about">-about me</a></div><div class="main-menu"><a href="/1">-Spring</a><div><a href="/2">-Summer</a></div></div>
    <div class="post-content"><h2>+Pruning old apple trees</h2><p>+An old tree wants light in its middle, so start with the branches that cross, and leave the young wood alone for a year.</p>
    <p>+Short cuts.</p><ul><li>+Saw</li><li>+Ladder that stands on uneven ground without a helper</li></ul></div>
    <div id="comments"><h3>-Two comments</h3><article class="comment"><p>-I have tried this on my own trees and it worked better than I thought it would, thank you.</p></article>
    <article class="comment"><p>-Nice</p></article></div><div class="sidebar"><h3>-Archive</h3><p>-The notebook has been kept since 1998 and has readers in more than thirty countries by now.</p></div>""",
    # documentation: main element, breadcrumbs, table of contents
    """<header><p>-Widget manual</p><form>-Search the manual by word <input></form></header><nav class="toc"><a href="#a">-Installing</a><p><a href="#b">-Configuring the widget for a cluster</a></p></nav>
    <main><h1>+Installing</h1><p>+Unpack the archive in a folder of your choice.</p><pre>+tar xf widget.tar</pre><p>+Then run the <a href="/x">setup program</a>, which asks for a licence key, a port and the name of the operator.</p>
    <table><tr><td>+Port</td><td>+Any free number above one thousand and twenty four</td></tr></table></main><aside>-Did you know that the widget also runs on small machines with little memory and no disk?</aside>
    <footer><p>-Written by many hands</p></footer>""",
    # notices and forms around an article
    """<div role="alert" class="cookie-notice">-We use cookies to remember your settings and to count our visitors, and you can say no to them in your browser.</div>
    <article><h1>+The last lamplighter</h1><p>+He walked the same four streets for forty years, and nobody in the town could say when he had begun.</p><p>+Every dusk.</p>
    <blockquote>+I never missed an evening, not even in the war.</blockquote></article><form id="newsletter"><p>-Leave your address and we send you our letter on the first day of each month, free of charge.</p><label>-Address</label></form>
    <section class="related"><h4>-More stories</h4><p><a href="/q">-The bridge that was never crossed</a></p></section>""",
    # no marks at all: words and links decide
    """<div><a href="/a">-Start</a></div><div><a href="/b">-News</a></div><div><a href="/c">-Contact</a></div>
    <div>+The survey of the northern cliffs took two summers, because the boats could only land at low water and in an easterly wind.</div>
    <div>+In the first summer the party mapped the caves, and in the second it counted the birds that nest above them in great numbers.</div>
    <div>+A report of more than two hundred pages was handed to the council, which thanked the party and put the report into its archive.</div>
    <div><a href="/d">-Imprint</a></div><div>-Updated in May</div>""",
    # no marks, old tables
    """<table><tr><td><a href="/1">-Products</a></td><td><a href="/2">-Prices</a></td></tr></table>
    <center>+Our family has been building clocks in this valley since the eighteenth century, always by hand and always one at a time.</center>
    <center>+Each movement takes about four months, and the case another two, so that we finish no more than a handful in a good year.</center>
    <center><a href="/3">-Back to top</a></center><center>-Counter 10293</center>""",
    # a page in one form, an article in it, roles in place of elements
    """<form id="page"><div role="navigation"><a href="/">-Portal</a><div><a href="/k">-Kontakt</a></div></div><div role="main"><h1>+Neue Brücke</h1>
    <p>+Die Brücke über den Fluss ist seit gestern für den Verkehr frei, nachdem die Prüfer keinen Mangel gefunden haben.</p><p>+Endlich.</p></div>
    <div role="contentinfo">-Herausgegeben von der Stadt, die für fremde Inhalte keine Haftung übernimmt und auf ihre Regeln verweist.</div></form>""",
    # share bars, bylines and advertisements inside an article
    """<article><header><h1>+Salt</h1></header><div class="share-buttons"><a href="/f">-Share</a><p>-Tell your friends about this piece on the network that you like best of all</p></div>
    <p>+Salt was money once, and the roads that carried it are still on our maps.</p><div class="advert"><p>-Learn a language in ten weeks with our tested course for busy people and their families at home.</p></div>
    <p>+The old mine closed in 1964.</p><p><a href="/m">+A map of the salt roads</a></p><footer>-Filed under history and trade</footer></article><div class="comments"><p>-First!</p><p>-My grandfather worked in that mine for thirty years and told us of its lamps and horses many times.</p></div>""",
    # long navigation and short text
    """<nav><p>-Choose one of our many departments from the list below, or type a word into the field at the top of this page to search.</p><ul><li><a href="/1">-Kitchen, table and household goods</a></li></ul></nav>
    <article><p>+Closed today.</p></article><aside class="widget"><p>-Weather: sunny</p><p>-Readers of this page also looked at the following pages in the course of the last seven days.</p></aside>
    <footer><a href="/i">-Imprint</a><p>-All prices include tax where it applies, and delivery where we say so on the page of the item.</p></footer>""",
    # an empty article
    """<nav><a href="/">-Home</a></nav><div class="banner">-Sale</div><article></article><div class="popup">-Before you go, have a look at what we have put together for you and your friends this week.</div><footer>-Version 3</footer>""",
    # class names of a content system, modifiers that say nothing
    """<div class="page has-sidebar"><div class="site-header">-The Weekly Barge</div><div class="entry-content"><p>+Barges need water under them, and this summer there was none to spare on the upper canal.</p><p>+So we walked.</p></div>
    <div class="widget-area sidebar"><p>-Subscribe</p><p>-Last week's most read piece was about locks, keepers and the pay that they get for their work at night.</p></div><div class="site-footer">-Printed on paper by people who read it</div></div>""",
    # no marks, links between paragraphs
    """<p><a href="/p">-previous page</a></p><p>+When the ice went out that spring it took the old jetty with it, and for a month the mail came overland on two wheels.</p>
    <p>+Nobody minded much, for the road was dry and the postman liked to talk, and so we heard more news than ever before.</p><p><a href="/n">-next page</a></p><p>-Page 12</p>""",
    # nothing follows the article, and unmarked blocks stand beside it
    """<body><p>-Skip to the text</p><div>-Photo of the day: the lighthouse at low water, seen from the mole on the morning after the storm had passed over the bay and out to sea.</div>
    <article><h1>+Tides</h1><p>+Spring tides follow the full moon and the new moon by a day or two, and neap tides come halfway between.</p><p>+Mind the sand.</p></article>""",
    """<div>-You are here: start</div><article><p>+Wells in the village were dug by hand until the pumps came, and some of them are still in use for gardens.</p><p><a href="/w">+Wells on the map</a></p><p>+Ask first.</p></article>
    <div>-Wells of other villages and the people who dug them are the theme of our spring issue, which is on sale now.</div><div>-Up</div>""",
    # articles that are links for the most part
    """<main><h1><a href="/h">+Ferries</a></h1><p><a href="/1">+North pier</a></p><p><a href="/2">+South pier and the islands behind it</a></p></main><footer>-Times may change</footer>""",
    """<nav><a href="/">-Top</a></nav><article><p><a href="/s">+Sources</a></p><p>+None are known.</p><p>+Ink.</p></article>""",
    # one paragraph is all
    """<article><p>+Out of print.</p></article>""",
    """<div class="content"><p>+Moved to the new pages of the society, which you find under the old address with the new name.</p></div>""",
    """<p>+A stone bridge stood here before the flood of 1784 carried it off together with the mill, two carts and the miller's dog.</p>""",
    # a content system again: what follows the text is marked
    """<div id="content"><p>+Short.</p><p><a href="/full">+Read the full report of the commission</a></p></div><div class="pagination"><a href="/2">-Next</a><p>-Page two of nine</p></div><div id="footer">-Set in Garamond and printed with care</div>""",
]
