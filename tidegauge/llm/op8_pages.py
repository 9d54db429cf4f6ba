"""The labelled table of page blocks: typical page layouts, written by hand.

``{12}`` stands for twelve words of text, ``{a3}`` for a link of three words. A ``¶``
at the start of a block says that it is main text.
"""

from __future__ import annotations

PAGES = (
    # news story: short deck, byline, related links between paragraphs, comments below
    """<header><a href=/>{a2}</a><p>{4}</header><nav><ul><li>{a1}<li>{a1}<li>{a2}<li>{a1}</ul></nav>
    <main><article><h1>¶{9}</h1><p class=byline>{6}<p>¶{22}<p>¶{61}<p>¶{a4} {38}<p>¶{5}<ul class=related><li>{a8}<li>{a7}</ul><p>¶{47}<h2>¶{3}</h2><p>¶{80}<p>¶{12}</article>
    <section id=comments><h2>{1}</h2><p>{3}<p>{41}<p>{2}<p>{18}</section></main><aside><h3>{2}</h3><ul><li>{a6}<li>{a9}</ul></aside><footer><p>{9}<p>{a1} {a1} {a2}</footer>""",
    # blog post with tags and share links that no name gives away
    """<div id=top>{a3}</div><ul><li>{a1}<li>{a1}<li>{a1}</ul><article><h1>¶{5}</h1><p>¶{1}<p>¶{33}<p>¶{90}<p>¶{a2}<p>¶{58}<blockquote>¶{25}</blockquote><p>¶{7}
    <ul><li>{a1}<li>{a1}<li>{a1}<li>{a2}</ul></article><div><ul><li>{a7}<li>{a6}<li>{a8}</ul></div><div>{11}</div>""",
    # recipe: many short lines inside an article
    """<nav>{a1} {a1} {a1}</nav><div class=ad>{8}</div><article><h1>¶{4}</h1><p>¶{28}<h2>¶{1}</h2><ul><li>¶{3}<li>¶{4}<li>¶{2}<li>¶{5}<li>¶{3}</ul><h2>¶{1}</h2><ol><li>¶{14}<li>¶{9}<li>¶{21}</ol>
    <div class=advert>{13}</div><p>¶{17}</article><form><p>{7}<label>{2}</label></form><footer>{14}</footer>""",
    # article cut short in its second paragraph, with an advert before it
    """<nav><ul><li>{a1}<li>{a1}<li>{a1}</ul></nav><div class=ad>{12}</div><article><h1>¶{10}</h1><p>¶<b>{10}<br><p>¶{44}<p>¶{31}<p>¶{6}""",
    """<nav><ul><li>{a1}<li>{a1}</ul></nav><div class=ad>{4}</div><article><h1>¶{2}</h1><p>¶{2}<p>¶{1}</article><footer>{2} {6}</footer>""",
    """<nav><ul><li>{a1}<li>{a1}</ul></nav><div class=ad>{40}</div><article><h1>¶{60}</h1><p>¶{260}<p>¶{9}<p>¶{150}<p>¶{3}</article><footer>{30}</footer>""",
    # encyclopaedia entry: linked words, a table of contents, see-also list, notes
    """<div class=sidebar><h3>{1}</h3><ul><li>{a2}<li>{a2}<li>{a1}</ul></div><main><h1>¶{2}</h1><p>¶{14} {a2} {20} {a1} {9} {a3}<div class=navigation><p>{1}<ul><li>{a1}<li>{a2}<li>{a2}</ul></div>
    <h2>¶{1}</h2><p>¶{50} {a1} {12} {a2}<p>¶{a1} {22} {a2} {8}<ul><li>¶{9} {a1}<li>¶{12}<li>¶{a2} {7}</ul><h2>¶{2}</h2><p>¶{70} {a4}</main><footer><ul><li>{a2}<li>{a2}</ul><p>{31} {a3}</footer>""",
    # manual page: headings, code, notes
    """<nav><ul><li>{a2}<li>{a3}<li>{a2}<li>{a1}</ul></nav><main><h1>¶{3}</h1><p>¶{18}<pre>¶{6}</pre><p>¶{3}<pre>¶{22}</pre><h2>¶{2}</h2><p>¶{30} {a1}<dl><dt>¶{1}<dd>¶{11}<dt>¶{1}<dd>¶{16}</dl></main><div class=pager>{a2} {a2}</div>""",
    # plain old page: no article element, tables for layout
    """<table><tr><td>{a1}<td>{a1}<td>{a1}<td>{a2}</table><h1>¶{6}</h1><p>¶{75}<p>¶{42}<p>¶{103} {a2}<p>¶{19}<table><tr><td>{a1}<td>{a1}<td>{a1}</table><p>{5} {a2}""",
    # forum or blog without article element
    """<div>{a2}</div><div>{a1} {a1} {a1} {a1}</div><div><h2>¶{7}</h2><div>¶{52}</div><div>¶{36}</div><div>¶{8}</div><div>¶{64}</div></div><div class=comments><div>{45}</div><div>{30}</div></div><div>{a1} {a1} {2}</div>""",
    """<ul><li>{a1}<li>{a1}<li>{a1}<li>{a1}</ul><div><div>¶{120}</div><div>¶{88} {a1}</div><h3>¶{4}</h3><div>¶{140}</div><div>¶{26}</div></div><div>{a3}</div><div>{a5}</div><div>{a4}</div><div>{4} {a1}</div>""",
    """<p>{a1} {a1} {a1}<h1>¶{8}</h1><p>¶{24}<p>¶{35}<h2>¶{2}</h2><p>¶{40}<p>¶{6}<p>¶{55}<p>{a2} {a3} {a2}<p>{3} {a1}""",
    # plain text full of links
    """<div>{a1} {a1} {a1}</div><h1>¶{3}</h1><p>¶{20} {a3} {10} {a4} {9}<p>¶{30} {a8} {12}<p>¶{40} {a11}<p>¶{16} {a4}<p>¶{24} {a9} {8}<div>{a2} {2}</div><p>{a3} {4} {a2}""",
    # press release, one long block and few links
    """<div class=header>{5}</div><div class=menu>{a1} {a1}</div><h1>¶{11}</h1><div>¶{230}</div><div class=footer>{20} {a2}</div>""",
    # shop page: description among lists of links and notices
    """<div class=cookie><p>{19}<p>{a1}</div><nav>{a1} {a2}</nav><h1>¶{5}</h1><p>¶{46}<p>¶{31}<ul><li>¶{7}<li>¶{8}<li>¶{6}</ul><p>¶{29}<ul><li>{a4}<li>{a5}<li>{a4}<li>{a6}</ul><div class=newsletter>{12}</div>""",
    # front page: nothing but links and teasers of a line
    """<nav>{a1} {a1} {a1}</nav><div><h3>{a6}</h3><p>{9} {a2}</div><div><h3>{a7}</h3><p>{8} {a2}</div><div><h3>{a5}</h3><p>{7} {a2}</div><ul><li>{a4}<li>{a5}</ul><footer>{8}</footer>""",
    """<div>{a2}</div><ul><li>{a3}<li>{a4}<li>{a3}<li>{a5}<li>{a4}</ul><div>{3}</div><ul><li>{a2}<li>{a2}</ul><div>{6} {a1}</div>""",
    # interview: many short paragraphs in an article, links in the middle of the text
    """<header><p>{3}</header><article><h1>¶{7}</h1><p>¶{16}<p>¶{4}<p>¶{9}<p>¶{2}<p>¶{27}<p>¶{a6}<p>¶{34}<p>¶{3} {a2}<p>¶{15}</article><aside><p>{22}<p>{a4}</aside><div class=share>{a1} {a1} {a1}</div>""",
    # article whose page header stands inside, share links above the text, endnotes of links
    """<article><header class=entry-header><h1>¶{6}</h1></header><div>{a1} {a1} {a1} {a1}</div><p>¶{39}<p>¶{72}<p>¶{20} {a2}<div><p>{a5}<p>{a6}<p>{a4}</div></article><div class=widget><h4>{2}</h4><p>{26}</div><footer>{17}</footer>""",
    # sign-in notice over a text
    """<dialog><p>{24}<p>{a2}</dialog><div class=banner>{10}</div><main><h1>¶{4}</h1><p>¶{57}<p>¶{1}<p>¶{49}<div class=subscribe><p>{15}</div><p>¶{66}</main><div class=promo><p>{33}</div>""",
    # poem: only short lines, no article
    """<div>{a1} {a1} {a1}</div><h1>¶{3}</h1><p>¶{7}<p>¶{6}<p>¶{8}<p>¶{7}<p>¶{6}<p>¶{7}<p>¶{8}<div>{a2} {a1}</div>""",
    # short texts right behind a menu; short lines and links inside an article
    """<nav><ul><li>{a1}<li>{a1}</ul></nav><article><h1>¶{3}</h1><p>¶{1}<p>¶{2}<p>¶{1}</article><footer>{5}</footer>""",
    """<ul><li>{a1}<li>{a2}</ul><article><h1>¶{2}</h1><p>¶{2}</article>""", """<div>{a1} {a2}</div><article><p>¶{1}<p>¶{1}<p>¶{3}<p>¶{2}</article><div>{a2} {a1}</div>""",
    """<nav>{a2} {a1}</nav><main><h2>¶{1}</h2><p>¶{2}</main>""", """<article><h1>¶{4}</h1><p>¶{30}<p>¶{2} {a2} {2}<p>¶{41}<p>¶{a3} {1}<p>¶{33}<p>¶{1} {a1}<p>¶{27} {a9}</article>""",
    """<article><h2>¶{a4}</h2><p>¶{36} {a2}<h2>¶{a6}</h2><p>¶{28} {a2}<h2>¶{a5}</h2><p>¶{44}</article><ul><li>{a3}<li>{a4}<li>{a5}<li>{a4}</ul>""",
    """<article><h1>¶{6}</h1><p>¶{52}<p>¶{2} {a12}<p>¶{8}<p>¶{a1}<p>¶{64}<ul><li>{a9}<li>{a7}<li>{a11}<li>{a8}</ul></article><div>{a2} {a3}</div><div>{3}</div><div>{a2}</div>""",
    """<div>{a1}</div><div>{2}</div><div>{a1} {a1}</div><div>{1}</div><div>{a3}</div><article><p>¶{20}<p>¶{3}</article><div>{a3}</div><div>{2}</div><div>{a2}</div>""",
    # a line of links right before long text; linked headings of teasers around an article
    """<div>{a1} {a1}</div><div>¶{60}</div><div>¶{44}</div><div>{a2}</div>""", """<div>{a3}</div><p>¶{35}<p>¶{28}""", """<p>{a2} {a1}<p>¶{90}<p>¶{31}<p>{a1}""",
    """<main><article><h1>¶{2}</h1><p>¶{40}</article><div class=related><h3>{a2}</h3><p>{30}<h3>{a3}</h3><p>{45}<h3>{a6}</h3><p>{38}</div></main>""",
    """<aside><h4>{a3}</h4><p>{33}<h4>{a5}</h4><p>{24}</aside><article><h1>¶{a7}</h1><p>¶{29}<p>¶{a3}<p>¶{60}</article><section class=promo><p>{a4}<p>{51}</section><footer>{a2}<p>{40}</footer>""",
    # titles of one word behind a menu
    """<nav>{a1} {a1}</nav><main><h2>¶{1}</h2><p>¶{27}<p>¶{14}</main><footer>{3}</footer>""", """<ul><li>{a1}<li>{a1}</ul><article><h1>¶{1}</h1><p>¶{19}<p>¶{70}</article>""",
    """<header>{a2}</header><article><h1>¶{1}</h1><h2>¶{8}</h2><p>¶{51}</article><div>{a1}</div><div>{1}</div><div>{a2} {a1}</div><div>{1}</div><div>{11}</div>""",
    # short paragraphs that are links, in and out of articles; short pages of even paragraphs
    """<article><p>¶{3}<p>¶{a4}<p>¶{2}</article>""", """<article><h1>¶{3}</h1><p>¶{6}<p>¶{a5}<p>¶{7}<p>¶{a3}<p>¶{5}</article><ul><li>{a2}<li>{a3}</ul>""", """<nav>{a1}</nav><article><p>¶{12}<p>¶{a6}<p>¶{9}</article>""",
    """<p>¶{3}<p>¶{a4}<p>¶{2}""", """<p>¶{5}<p>¶{a5}<p>¶{6}<p>¶{4}""", """<p>¶{6}<p>¶{5}<p>¶{6}<p>¶{5}<p>¶{4}<p>¶{6}<p>¶{5}<p>¶{6}<p>¶{5}<p>¶{5}<p>¶{6}<p>¶{4}""",
    """<h1>¶{3}</h1><p>¶{8}<p>¶{9}<p>¶{7}<p>¶{9}<ul><li>{a2}<li>{a3}<li>{a2}</ul>""", """<div>{a2} {a1} {a2}</div><h2>¶{4}</h2><p>¶{7}<p>¶{9}<p>¶{6}<div>{a2} {a1}</div>""",
    """<p>¶{4}<p>¶{a3}<p>¶{3}""", """<p>¶{2}<p>¶{a2}<p>¶{2}""", """<article><h1>¶{1}</h1><p>¶{28}<p>¶{28}<ul><li>{a2}<li>{a2}<li>{a2}</ul></article>""",
    """<article><h1>¶{2}</h1><p>¶{40}<p>¶{22}<ul><li>{a1}<li>{a3}<li>{a2}<li>{a2}</ul></article><footer>{2}</footer>""", """<main><h1>¶{1}</h1><p>¶{30}<ul><li>{a3}<li>{a2}<li>{a3}</ul></main>""",
    """<nav>{a1} {a3}</nav><article><p>¶{4}<p>¶{a3}<p>¶{3}</article><footer>{6}</footer>""", """<nav>{a2} {a2}</nav><article><h1>¶{2}</h1><p>¶{2}<p>¶{a5}<p>¶{3}<p>¶{a2}</article><footer>{3}</footer>""",
    """<nav>{a1} {a3}</nav><p>¶{4}</p><p>¶{a3}</p><p>¶{3}</p><footer>{6}</footer>""", """<nav>{a2} {a1}</nav><p>¶{2}</p><p>¶{a5}</p><p>¶{2}</p><footer>{5}</footer>""",
    # class names that say nothing, and names that do, around equal texts
    """<nav>{a1}</nav><main><div class=widget><h1>¶{3}</h1><p>¶{60}<p>¶{44}</div></main><footer>{4}</footer>""", """<div class=tags-page><p>¶{9}<p>¶{8}</div>""",
    """<article class="post sponsored"><h1>¶{4}</h1><p>¶{50}<div class=sponsored><p>{24}</div><p>¶{38}</article>""", """<div class=share-story><h2>¶{5}</h2><p>¶{70}<p>¶{33}</div><div class=share>{a1} {a1}</div>""",
    # pages of well-known kinds: question and answer, changelog, index of a manual, wiki with notes
    """<header><a href=/>{a1}</a><form>{2}</form></header><nav>{a1} {a1} {a2}</nav><div id=content><h1>¶{9}</h1><div class=post-text><p>¶{44}<pre>¶{18}</pre><p>¶{12}</div><div class=comments-link>{a3}</div></div><div id=sidebar><h4>{2}</h4><ul><li>{a9}<li>{a8}<li>{a10}</ul></div>""",
    """<div class=topbar>{a1} {a1}</div><div class=page><h1>¶{2}</h1><h2>¶{3}</h2><ul><li>¶{9}<li>¶{12}<li>¶{7}</ul><h2>¶{3}</h2><ul><li>¶{6}<li>¶{14}</ul></div><div class=page-nav>{a2} {a2}</div>""",
    """<div class=related><ul><li>{a1}<li>{a1}</ul></div><main><h1>¶{2}</h1><p>¶{26}<p>¶{a3}<p>¶{31}</main><div class=sphinxsidebar><h3>{3}</h3><ul><li>{a3}<li>{a2}</ul></div><div class=footer>{9} {a1}</div>""",
    """<article><h1>¶{2}</h1><p>¶{33} {a2} {8}<figure><figcaption>¶{7}</figcaption></figure><p>¶{48}<table><tr><td>¶{2}<td>¶{3}</table><p>¶{20}</article><div class=catlinks>{a1} {a2} {a2}</div>""",
    # one paragraph, nothing around it
    "<p>¶{4}", "<p>¶{3} {a2}", "<p>¶{2}", "<div>¶{6}</div>",
    "<p>¶{30}", "<p>¶{5}<p>¶{9}", "<h1>¶{4}</h1><p>¶{18}", "<article><p>¶{2}</article>", "<main><p>¶{12}<p>¶{1}</main>", "<article><h1>¶{a5}</h1><p>¶{25}<p>¶{60}</article>",
)
