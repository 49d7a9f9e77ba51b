"""Pages written by hand, of layouts and markup that the trainer's page maker doesn't make, each with its main text."""

PAGES = [
    # a news site of nested boxes
    ('<html><head><title>T</title><link rel=x></head><body class="page"><div id="hd"><a href="/">The Daily Paper</a></div><div class="wrap"><div class="l-main"><div class="story__headline"><h1>Rain stops play</h1></div>'
     '<div class="story__body"><p>The match was halted at noon, after an hour of heavy rain.</p><p>Play will go on tomorrow at ten.</p></div></div><div class="l-rail sidebar"><h4>Most read</h4><ol><li><a href=1>One</a><li><a href=2>Two</a></ol></div></div><footer>© Paper</footer></body></html>',
     "Rain stops play\nThe match was halted at noon, after an hour of heavy rain.\nPlay will go on tomorrow at ten."),
    # a formula inside a sentence
    ("<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><article><h1>Roots</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>3</mn></math> be the root, then the sum is five.</p></article></body>",
     "Roots\nLet x=3 be the root, then the sum is five."),
    # a button inside a sentence
    ("<main><h1>How to start</h1><p>Press <button>Start</button> and wait for the second light to come on.</p><p>Then let go.</p></main><footer>Imprint</footer>",
     "How to start\nPress Start and wait for the second light to come on.\nThen let go."),
    # a paragraph for browsers without scripts, inside the article
    ("<article><h2>Chart of the week</h2><p>The chart below shows the sales of the year.</p><noscript><p>In spring 20, in summer 35, in autumn 12.</p></noscript></article><div class='cookie-banner'>We use cookies.</div>",
     "Chart of the week\nThe chart below shows the sales of the year.\nIn spring 20, in summer 35, in autumn 12."),
    # tables for layout, as long ago
    ("<html><body bgcolor=white><table width=100%><tr><td colspan=2 class=header><b>My home page</b></td></tr><tr><td class=menu><a href=a>A</a><br><a href=b>B</a><br><a href=c>C</a></td><td class=content>"
     "<h1>Building a boat</h1><p>First, find good wood, dry and straight.<p>Then cut the planks by the plan, and leave them for a week.</td></tr></table></body></html>",
     "Building a boat\nFirst, find good wood, dry and straight.\nThen cut the planks by the plan, and leave them for a week."),
    # a blog with comments and a form
    ('<body><header class="site-header"><h1><a href="/">Kitchen notes</a></h1></header><div class="hentry"><h2 class="entry-title">Plum cake</h2><div class="entry-content"><p>Take two eggs, some flour and a pound of plums.</p><ul><li>Stone the plums.</li><li>Beat the eggs.</li></ul>'
     '<p>Bake it for forty minutes.</p></div></div><div id="comments"><h3>2 replies</h3><div class="comment"><p>Lovely, made it twice, and the children liked it very much indeed.</p></div></div><form id="commentform"><label>Name</label><input><textarea></textarea><button>Post</button></form></body>',
     "Plum cake\nTake two eggs, some flour and a pound of plums.\nStone the plums.\nBeat the eggs.\nBake it for forty minutes."),
    # definitions and code
    ("<body><div role=navigation class=toc><ul><li><a href=#a>open</a></li><li><a href=#b>close</a></li></ul></div><div class=document><h1>File calls</h1><dl><dt>open(name)</dt><dd>Opens a file and gives a handle.</dd><dt>close(handle)</dt><dd>Closes it.</dd></dl><pre>h = open('x')\nclose(h)</pre></div></body>",
     "File calls\nopen(name)\nOpens a file and gives a handle.\nclose(handle)\nCloses it.\nh = open('x') close(h)"),
    # an advert between paragraphs
    ("<article><h1>On the river</h1><p>We left at dawn, with little wind and a clear sky.</p><div class='ad-slot'><p>Half price shoes, only today!</p></div><p>By noon we had reached the old mill.</p></article>",
     "On the river\nWe left at dawn, with little wind and a clear sky.\nBy noon we had reached the old mill."),
    # character references, white space, comments
    ("<body><article><h1>Caf&eacute; &amp; bar</h1><!-- <p>not this</p> --><p>Open\n\n  from  8&nbsp;to&#160;5, &lt;closed&gt; on Sundays&hellip;</p></article></body>",
     "Café & bar\nOpen from 8 to 5, <closed> on Sundays…"),
    # a select list left open before the article
    ("<body><form action=/go><select name=lang><option>English<option>Deutsch</select></form><article><h1>Lake report</h1><p>The water stands two metres above the mark of last year, and it rises.</p></article></body>",
     "Lake report\nThe water stands two metres above the mark of last year, and it rises."),
    # no head or body tags at all
    ("<title>t</title><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><main><h1>Plain page</h1><p>There is neither a head nor a body tag here, which is allowed.</main>",
     "Plain page\nThere is neither a head nor a body tag here, which is allowed."),
    # a figure and its caption
    ("<article><h1>The bridge</h1><figure><img src=b.jpg><figcaption>The bridge in winter, seen from the north.</figcaption></figure><p>It was built in two years and opened in May.</p><div class='share-buttons'><button>Share</button><button>Save</button></div></article>",
     "The bridge\nThe bridge in winter, seen from the north.\nIt was built in two years and opened in May."),
    # a data table in an article
    ("<main class=wiki><h1>Rivers</h1><p>The three longest rivers of the country are these.</p><table><caption>Lengths</caption><tr><th>Name</th><th>km</th></tr><tr><td>Ora</td><td>312</td></tr><tr><td>Tiel</td><td>255</td></tr></table></main>",
     "Rivers\nThe three longest rivers of the country are these.\nLengths\nName\nkm\nOra\n312\nTiel\n255"),
    # only a short text
    ("<body><header><a href=/>Weather</a></header><article><p>Sun.</p></article><footer><p>All rights reserved</p></footer></body>", "Sun."),
    # Cyrillic
    ("<body><nav><a href=/>Главная</a></nav><article><h1>Новости дня</h1><p>Сегодня утром в городе открыли новый мост через реку.</p></article><aside><h3>Читайте также</h3><ul><li><a href=1>Погода</a></li></ul></aside></body>",
     "Новости дня\nСегодня утром в городе открыли новый мост через реку."),
    # Chinese, without spaces
    ("<body><div class='nav'><a href=/>首页</a></div><div class='article-content'><h1>春天</h1><p>春天来了，花园里的花都开了，孩子们在外面玩。</p></div><div class='footer'>版权所有</div></body>",
     "春天\n春天来了，花园里的花都开了，孩子们在外面玩。"),
    # quotation and emphasis
    ("<article><h1>A letter</h1><p>He <em>never</em> wrote <strong>so much</strong> as in <span>that year</span>.</p><blockquote><p>I am well, and the garden is green.</p></blockquote><p>It ends there.</p></article><div class='newsletter-signup'><p>Get our letters by mail!</p><input></div>",
     "A letter\nHe never wrote so much as in that year.\nI am well, and the garden is green.\nIt ends there."),
    # a dialog over the page
    ("<body><dialog open><p>Please accept our terms before you read on.</p><button>Accept</button></dialog><main><article><h1>Old maps</h1><p>Old maps show the coast as sailors saw it, bay by bay.</p></article></main></body>",
     "Old maps\nOld maps show the coast as sailors saw it, bay by bay."),
    # sections with their own headings
    ("<article><h1>Bees</h1><section><h2>Summer</h2><p>In summer a hive holds forty thousand bees.</p></section><section><h2>Winter</h2><p>In winter there are ten thousand, close together.</p></section></article><nav class=pager><a href=p>Previous</a> <a href=n>Next</a></nav>",
     "Bees\nSummer\nIn summer a hive holds forty thousand bees.\nWinter\nIn winter there are ten thousand, close together."),
    # broken nesting
    ("<body><div class=main-content><h1>Broken</h1><p>One <b>bold <i>both</b> italic</i> end of it.</div></p><p>Second part of the text, after a wrong end tag.</p><div class=footer>Contact us</div></body>",
     "Broken\nOne bold both italic end of it.\nSecond part of the text, after a wrong end tag."),
    # scripts that write tags
    ("<body><script>document.write('<article><p>No</p></article>')</script><style>p:before{content:'<p>'}</style><article><h1>Scripts</h1><p>Only this sentence is on the page for a reader.</p></article></body>",
     "Scripts\nOnly this sentence is on the page for a reader."),
    # capitals in tags, attributes without quotes
    ("<HTML><BODY><DIV ID=menu><A HREF=/>START</A></DIV><ARTICLE CLASS=post><H1>Loud tags</H1><P>Tags were written in capitals for a long time.</ARTICLE></BODY></HTML>",
     "Loud tags\nTags were written in capitals for a long time."),
    # a breadcrumb and a byline
    ("<body><ul class=breadcrumb><li><a href=/>Home</a></li><li><a href=/s>Sport</a></li></ul><article><h1>Final won</h1><p class=byline>By A. Writer</p><p>The home side won the final by two goals to one.</p></article></body>",
     "Final won\nThe home side won the final by two goals to one."),
    # links inside the text, a related list after it
    ("<article><h1>Reading list</h1><p>The <a href=1>first book</a> is long, the <a href=2>second</a> is short, and both are worth your time.</p></article><section class=related-posts><h2>Related</h2><ul><li><a href=3>Other lists</a></li><li><a href=4>More books</a></li></ul></section>",
     "Reading list\nThe first book is long, the second is short, and both are worth your time."),
    # a hidden box
    ("<body><div style='display:none'><p>This is kept for later, and nobody sees it now.</p></div><article><h1>Seen</h1><p>This is what the reader sees on the page.</p></article></body>", "Seen\nThis is what the reader sees on the page."),
    # steps in an ordered list
    ("<main><h1>Change a tyre</h1><ol><li>Loosen the nuts a little.<li>Lift the car.<li>Take the wheel off and put on the other.</ol><p>Check the nuts again after a day.</p></main><div class=advertisement><a href=x>Cheap tyres here</a></div>",
     "Change a tyre\nLoosen the nuts a little.\nLift the car.\nTake the wheel off and put on the other.\nCheck the nuts again after a day."),
    # a details element
    ("<article><h1>Riddle</h1><p>What has a bed but never sleeps, and a mouth but never eats?</p><details><summary>Answer</summary><p>A river has.</p></details></article><footer class=colophon>Made by hand</footer>",
     "Riddle\nWhat has a bed but never sleeps, and a mouth but never eats?\nAnswer\nA river has."),
    # a menu page without an article
    ("<body><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></nav><footer><p>Copyright</p></footer></body>", ""),
    # a forum question with its code
    ("<body><div class=topbar><a href=/>Ask</a><form><input></form></div><div class='question post-text'><h1>How do I sort a list?</h1><p>I have a list of numbers and need the largest first.</p><pre><code>xs = [3, 1, 2]</code></pre></div><div class=sidebar><h4>Hot questions</h4><ul><li><a href=1>Why is it slow?</a></li></ul></div></body>",
     "How do I sort a list?\nI have a list of numbers and need the largest first.\nxs = [3, 1, 2]"),
    # an unclosed quote in an attribute
    ("<article><h1 title=\"a>Odd quote</h1><p>The quote before was never closed, the text goes on all the same.</p></article>", "Odd quote\nThe quote before was never closed, the text goes on all the same."),
    # a notice and a paywall box round the text
    ("<body><div class='alert alert-info' role=alert>Trains are late today.</div><main><h1>Night train</h1><p>The night train runs again from June, three times a week.</p></main><div class=paywall><h3>Subscribe</h3><p>Read on for one coin a week.</p></div></body>",
     "Night train\nThe night train runs again from June, three times a week."),
    # text with line breaks and no paragraphs
    ("<body><div id=header>Poems</div><div id=content><h1>Evening</h1>The sun goes down behind the hill,<br>the birds are quiet, the mill is still.</div><div id=footer>2001</div></body>",
     "Evening\nThe sun goes down behind the hill, the birds are quiet, the mill is still."),
]
