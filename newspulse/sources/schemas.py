"""Fixed schemas of the article tables."""

ARTICLE_RAW = "title string, content string, date string, press string, url string"
ARTICLE_LINK = "title string, url string, press string, date string"
ARTICLE_LABELED = ARTICLE_RAW + ", sentiment string, sentiment_score double, sentiment_num int"
PRICE = "Date date, Close double"
FAILURE_LOG = "ts timestamp, url string, reason string"
HTML_PAGES = "page_id long, url string, html string"
