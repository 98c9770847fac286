"""Message texts, markers and site names that results must reproduce exactly."""

from __future__ import annotations

# --- fixed values: markers inside feed fields
TITLE_MARKER = "(arXiv:"
ABSTRACT_MARKER = "Abstract:"
AUTHOR_SEPARATOR = ", "

# --- fixed values: feed addresses (used as path prefixes; nothing is fetched)
DAILY_FEED_BASE = "https://rss.arxiv.org/rss/"
SIMILARITY_FEED_BASE = "http://export.arxiv.org/rss/"
NEW_SUFFIX = "/new"

# --- fixed values: metadata sets that are not under physics
NON_PHYSICS_SETS = ["cs", "econ", "eess", "math", "q-bio", "q-fin", "stat"]

# --- fixed values: characters Python's str.strip() removes
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)

# --- fixed values: tags put around highlighted words
TITLE_TAGS = ('<span style="color:darkblue">', "</span>")
BOLD_TAGS = ("<b>", "</b>")

# --- fixed values: match digest frame
MATCH_HEADER = "    <html>\n      <head></head>\n      <body>\n    "
MATCH_FOOTER = "</body>\n    </html>"

# --- fixed values: one entry of a match digest, around link, title, authors and abstract
ENTRY_HTML = (
    '<div><p style="color:blue;font-size:1.17em;"><b><a href="',
    '">',
    "</a></b></p><p><i>",
    "<i></p><br><p>",
    "</p><br><br></div>",
)
# --- fixed values: its plain form, after title, authors and abstract
ENTRY_TEXT = ("\n \t", "\n \n", "\n \n")

# --- fixed values: one item of the journal digest, around title, date, link, link and summary
JOURNAL_ITEM = ("\n<li><strong>", "</strong><br>\n<em>", "</em><br>\n<a href='", "'>", "</a><br>\n", "</li><br>")
JOURNAL_SUMMARY = ("<p>", "</p>\n")

# --- fixed values: similarity digest frame (the doubled braces are literal)
SIMILARITY_HEADER = (
    "        <html>\n"
    "          <head>\n"
    "              <style>\n"
    "                table {{\n"
    "                  width: 100%;\n"
    "                  border-collapse: collapse;\n"
    "                }}\n"
    "            \n"
    "                td {{\n"
    "                  padding: 10px;\n"
    "                  border: 1px solid black;\n"
    "                }}\n"
    "              </style>          \n"
    "          </head>\n"
    "          <body>\n"
    "        "
)
SIMILARITY_FOOTER = "</body>\n        </html>"

# --- fixed values: one similarity pair; %1$s title, %2$s summary, %3$s link of the entry, then
# %4$s title, %5$s summary, %6$s link of the target
PAIR_TEMPLATE = (
    "\n"
    '      <table style="width: 100%%; border-collapse: collapse;">\n'
    "        <tr>\n"
    '          <td style="padding: 10px; border: 1px solid black;">\n'
    '            <h2><a href="%3$s">%1$s</a></h2>\n'
    "            <p>%2$s</p>\n"
    "          </td>\n"
    '          <td style="padding: 10px; border: 1px solid black; color: #888888;">\n'
    '            <h2><a href="%6$s" style="color: #888888;">%4$s</a></h2>\n'
    "            <p>%5$s</p>\n"
    "          </td>\n"
    "        </tr>\n"
    "      </table>\n"
    "    "
)

# --- fixed values: journal digest
JOURNAL_HEADER = "<html><body>\n<h2>New JMLR Publications</h2>\n<ul>"
JOURNAL_FOOTER = "\n</ul></body></html>"
JOURNAL_PLAIN_HEADER = "New JMLR Publications:\n"
JOURNAL_SUBJECT = "JMLR Recent Articles"
JOURNAL_DEFAULTS = {"title": "No Title", "link": "", "published": "No Date", "summary": ""}

# --- fixed values: subjects and fallback texts; {site} stands for the feed's site
DAILY_SUBJECT = "Filtered Arxiv {site}"
SIMILARITY_SUBJECT = "Similarity Filter for Arxiv {site}"
WEEKLY_SUBJECTS = {
    "author": "Filtered author matches for {site}",
    "keyword": "Filtered matches for {site}",
}
WEEKLY_FALLBACKS = {
    "author": "No author matches found for {site} arxiv topic",
    "keyword": "No keyword matches found for {site} arxiv topic",
}
NOTHING_FOUND = "No articles found for any arxiv topic"

# --- fixed values: match labels and their codes
MATCH_CODES = {"author": 1, "title": 2, "summary": 3}
NO_MATCH_CODE = 4

# --- fixed values: weekday numbers, Monday = 0
SUNDAY = 6
