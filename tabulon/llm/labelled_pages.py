"""The labelled table of the page classifier: invented page layouts.

``{n}`` stands for n words of main text, ``[n]`` for n words of anything else; every block holds one of the two.
"""

_MENU = "<nav><ul>" + '<li><a href="/x">[1]</a></li>' * 6 + "</ul></nav>"
_LIST = "<ul>" + '<li><a href="/x">[4]</a></li>' * 5 + "</ul>"
_HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>"

PAGES = (
    _HEAD + _MENU + '<div class="ad">[8]</div><article><h1>{7}</h1><p><b>{40}<br><p>{90}</p><p>{2}</p><p>{1}</p><p>{12}</p></article><footer>[9]</footer></body></html>',
    _HEAD + _MENU + '<div class="ad">[2]</div><article><h1>{1}</h1><p>{3}</p></article><footer>[4]</footer></body></html>',
    _HEAD + _MENU + "<div class=ad>[14]</div><article><h1>{9}</h1><p><b>{5}<br><p>{300}</p><p>{1}</p></article><footer>[30]</footer>",
    _HEAD + '<header><a href="/">[2]</a><p>[6]</p></header>' + _MENU + "<main><h1>{6}</h1><p>{60}</p><h2>{3}</h2><p>{25}</p><ul><li>{4}</li><li>{9}</li></ul><blockquote>{20}</blockquote></main><aside><h3>[2]</h3>" + _LIST + "<p>[20]</p></aside><footer><p>[15]</p><a href=/>[2]</a></footer>",
    _HEAD + '<div id="header"><h1>[3]</h1><p>[8]</p></div><div class="menu">' + _LIST + '</div><div id="content"><h1>{5}</h1><p>{50}</p><p>{4}</p><p>{30}</p><table><tr><td>{2}</td><td>{1}</td></tr></table></div><div class="sidebar"><p>[12]</p>' + _LIST + '</div><div id="footer">[12]</div>',
    _HEAD + '<div class="cookie-notice"><p>[24]</p><button>[2]</button></div><article><header><h1>{6}</h1></header><p>{70}</p><div class="advert">[10]</div><p>{35}</p><p>{6}</p><form action="/s"><label>[3]</label><p>[9]</p><input></form></article><section id="comments"><h2>[2]</h2><div class="comment"><p>[30]</p></div><div class="comment"><p>[3]</p></div></section><footer>[6]</footer>',
    _HEAD + '<article class="post"><h1>{5}</h1><p class="byline">[4]</p><p>{45}</p><aside><p>[25]</p></aside><p>{8}</p><div class="related"><h3>[2]</h3>' + _LIST + '</div><div class="comments"><article class="comment"><p>[40]</p></article><article class="comment"><p>[2]</p></article></div></article>',
    _HEAD + '<div class="wrapper">' + _LIST + '<div><h1>{6}</h1><p>{40}</p><p>{55}</p><p>{20}</p></div><div>' + _LIST + "</div><div>[5]</div></div>",
    _HEAD + "<table><tr><td><a href=1>[1]</a></td><td><a href=2>[1]</a></td></tr></table><h2>{4}</h2><p>{35}<p>{48}<p>{15}<hr><a href=3>[2]</a><a href=4>[1]</a>",
    _HEAD + '<main><div role="alert">[16]</div><section><h2>{3}</h2><p>{22}</p><p>{38}</p></section><section class="newsletter"><h3>[4]</h3><p>[15]</p><form><p>[6]</p></form></section><nav>' + _LIST + "</nav></main>",
    _HEAD + '<div class="social share"><a href=1>[1]</a><a href=2>[1]</a></div><article><h1>{8}</h1><figure><figcaption>{7}</figcaption></figure><p>{18} </p><ol><li>{12}</li><li>{3}</li><li>{25}</li></ol><pre>{15}</pre><p>{2}</p></article><div class="sponsor"><p>[30]</p><p>[45]</p></div>',
    _HEAD + '<header><h1>[2]</h1><p>[40]</p></header><article><p>{1}</p><p>{1}</p><p>{2}</p></article><footer><p>[60]</p><p>[3]</p></footer>',
    _HEAD + '<div id="main-content"><p>{80}</p><p>{3}</p><div class="notice"><p>[22]</p></div><p>{5}</p></div><div id="disqus_thread"><p>[50]</p><p>[7]</p></div><div class="copyright">[8]</div>',
    _HEAD + "<article><h1>{4}</h1><p>{12}</p></article><article><h1>{3}</h1><p>{66}</p></article><div hidden><p>[33]</p></div><form><p>[28]</p></form>",
    _HEAD + _MENU + "<div>[3]</div><div>[6]</div><p>{30}</p><p>{44}</p><div>[2]</div>",
    _HEAD + '<article><h1>{5}</h1><p>{20}</p><ul><li><a href="/r">[6]</a></li><li><a href="/r">[5]</a></li></ul><p>{50}</p><p><a href="/m">[2]</a></p></article><aside>[3]</aside>',
    _HEAD + '<header class="site-header"><nav>' + _LIST + '</nav></header><div class="page-with-sidebar"><article><h2>{2}</h2><p>{9}</p><p>{110}</p></article><div class="sidebar"><p>[55]</p></div></div>',
    _HEAD + "<div><div>[4]</div>" + _LIST + "<div>[9]</div></div><div><h1>{7}</h1><p>{18}</p><p>{28}</p><p>{14}</p><p>{70}</p><p>{11}</p></div><div><div>[12]</div><div>[8]</div></div>",
    _HEAD + "<div>[5]</div><div><div>{42}</div><div>{33}</div><div>{61}</div><div>{19}</div></div><div>[7]</div><div>[3]</div>" + _LIST,
    _HEAD + '<p><a href="/">[1]</a> </p><p>{90}</p><p>{21}</p><p>{64}</p><p>{13}</p><p><a href="/c">[9]</a></p><p>[6]</p>',
    _HEAD + "<div>[10]</div><div>[3]</div><h2>{5}</h2><p>{25}</p><p>{17}</p><p>{120}</p><p>{31}</p><div>[11]</div><div>[4]</div><div>[10]</div>",
    _HEAD + _MENU + "<h1>{6}</h1><p>{55}</p><p>{12}</p><p>{44}</p><header>[20]</header><footer><p>[50]</p><p>[18]</p></footer>",
    _HEAD + '<div class="menu"><p>[30]</p><p>[40]</p></div><div><p>{35}</p><p>{50}</p><p>{16}</p></div><div class="ads"><p>[45]</p></div><div class="comments"><p>[60]</p><p>[14]</p></div>',
    _HEAD + '<section><h2>{4}</h2><p>{26}</p><p>{38}</p><h2>{5}</h2><p>{60}</p><p>{15}</p></section><section><p><a href=1>[6]</a></p><p><a href=2>[8]</a></p><p><a href=3>[12]</a></p></section>',
    _HEAD + "<ul><li>[2]</li><li>[3]</li><li>[2]</li></ul><p>{40}</p><ul><li>{14}</li><li>{22}</li></ul><p>{33}</p><ul><li>[2]</li><li>[1]</li></ul>",
    _HEAD + _MENU + "<article><h1>{6}</h1><p>{48}</p><p>{3}",
    _HEAD + '<header><p>[12]</p></header><article><p>{150}</p><p>{9}</p></article>',
    _HEAD + '<header><h1>[3]</h1></header><article><header><h1>{7}</h1></header><p>{130}</p><ul><li>{5}</li><li>{2}</li></ul></article>',
    _HEAD + "<form><p>[9]</p></form><main><h2>{4}</h2><p>{85}</p><p>{1}</p><h3>{2}</h3><p>{75}</p></main>",
    _HEAD + '<div id="content"><h1>{5}</h1><div>{64}</div><div>{2}</div></div>',
    _HEAD + '<aside><p>[6]</p></aside><article><div>{90}</div><div>{4}</div><aside><p>[8]</p></aside><p>{120}</p><blockquote>{6}</blockquote></article>',
    _HEAD + '<nav><span>[2]</span></nav><p>{100}</p><p>{30}</p><p>{80}</p><p>{22}',
    _HEAD + "<header>[3]</header><article><p>{2}</p></article>",
    _HEAD + '<article><h1>{3}</h1><p>{11}</p><footer>[6]</footer></article><aside><p>[4]</p></aside><article><p>{75}</p><footer>[9]</footer></article><article><p>{95}</p></article>',
    # Titles in an article's own header, of any length, and the site's own title in its header.
    _HEAD + '<header><h1>[5]</h1><p>[13]</p></header>' + _MENU + "<article><header><h1>{4}</h1></header><p>{14}</p><p>{3}</p></article><footer><p>[25]</p></footer>",
    _HEAD + '<header><a href="/"><h1>[8]</h1></a></header><article><header><h2>{2}</h2><p class="byline">[3]</p></header><p>{60}</p></article><footer><h2>[4]</h2><p>[40]</p></footer>',
    _HEAD + "<header><h2>[6]</h2></header><main><header><h1>{9}</h1></header><section><p>{33}</p><p>{5}</p></section></main><aside><h2>[5]</h2><p>[70]</p></aside>",
    # Paragraphs of an article that are mostly links; lists of links stay out.
    _HEAD + '<article><h1>{4}</h1><p>{30}</p><p>{8} <a href="/a">{14}</a> {3}</p><p>{41}</p><p>{4} <a href="/b">{9}</a></p><p>{52}</p><ul><li><a href="/r">[7]</a></li><li><a href="/r">[9]</a></li></ul></article>',
    _HEAD + _MENU + '<article><p><a href="/a">{6}</a> {5}</p><p>{38}</p><p>{7} <a href="/c">{21}</a> {2}</p><p>{19}</p></article><div>' + _LIST + "</div>",
    # No semantic markup: the neighbours of a short block decide.
    _HEAD + "<div>[13]</div><div>" + _LIST + "</div><h1>{5}</h1><p>{11}</p><p>{40}</p><p>{9}</p><p>{62}</p><div>" + _LIST + "</div><div>[14]</div>",
    _HEAD + "<div>" + _LIST + "</div><div>[16]</div><div>" + _LIST + "</div><h2>{6}</h2><p>{8}</p><p>{70}</p><p>{12}</p><p>{33}</p><div>[6]</div>",
    _HEAD + '<div><a href="/">[2]</a></div><h1>{7}</h1><p>{10}</p><p>{55}</p><p>{7}</p><p>{80}</p><p><a href="/n">[3]</a></p><div>[12]</div>',
    _HEAD + "<p>{6}</p><p>{58}</p><p>{44}</p><p>{5}</p><p>{37}</p>" + _LIST + "<p>[15]</p>" + _LIST,
)
