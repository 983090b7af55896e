"""Fixed values that results depend on: suffixes, rules, patterns and words, in the order in which they are tried."""

from __future__ import annotations

# Query keys that do not belong to a page's identity, besides utm_*.
TRACKING_KEYS = ("ref", "cta", "cta_page", "source", "fbclid", "gclid")

# Suffixes of two labels under which tenants or registrants are sites of their own.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au co.jp or.jp ne.jp ac.jp com.br com.mx com.ar com.co com.cn net.cn org.cn"
    " gov.cn edu.cn co.in net.in org.in co.nz co.za com.sg com.hk com.tw com.tr co.kr or.kr github.io gitlab.io vercel.app netlify.app"
    " pages.dev workers.dev herokuapp.com readme.io zendesk.com intercom.help usepylon.com"
).split()

# Statuses that are a gate and say nothing of the content; server errors of the classifier; hosts that answer bots with 400.
BLOCKED_STATUSES = (401, 402, 403, 405, 407, 429, 451, 999)
SERVER_ERRORS = (500, 502, 503, 504, 507, 508, 520, 521, 522, 523, 524, 525, 526, 527, 530)
HOSTILE_400_HOSTS = ("facebook.com", "www.facebook.com", "m.facebook.com", "instagram.com", "www.instagram.com")

# Link exclusion rules (id, pattern), first match wins.
EXCLUDE_URL_RULES = (
    ("cloudflare_email_protection", r"/cdn-cgi/l/email-protection"),
    ("mintlify_injected_anchor", r"/base-ui-[a-z0-9-]+$"),
    ("fern_injected_anchor", r"/fern-scroll-area-[a-z0-9-]+$"),
    ("fern_console_host", r"^https?://app\.buildwithfern\.com"),
    ("intellimize_endpoint", r"^https?://[\w.-]*intellimize(?:io)?\.(?:com|co)"),
    ("reserved_example_domain", r"^https?://(?:[\w-]+\.)*(?:example\.(?:com|org|net)|example|test|invalid|localhost)(?:[:/]|$)"),
    ("url_template_placeholder", r"(?i)[{<\[]\s*[a-z_][a-z0-9_]*\s*[}>\]]|%7B[a-z_]+%7D|:[a-z_]+Id(?:/|$)"),
    ("framework_bind_artifact", r"^(?::|x-bind:|v-bind:|@)?href$|^\{\{"),
    ("non_http_scheme", r"(?i)^(?:mailto|tel|sms|javascript|data|ftp|file|slack|intent):"),
)
API_PATH = r"(?i)/(?:api|v[0-9]+|graphql|rest)(?:/|$)"
CODE_CONTEXT = r"(?i)</?(?:code|pre|kbd|samp)\b|\bcurl\b|\bfetch\(|\brequests\.(?:get|post)\b"
INLINE_HIDDEN = r"(?i)style\s*=\s*[\"'][^\"']*display\s*:\s*none"

# Challenge marks in the first 20,000 characters of a body; those of AMBIGUOUS count only where the page looks like a gate.
CHALLENGE_BODY = (
    ("cf_just_a_moment", r"(?i)just a moment\s*\.{0,3}"),
    ("cf_browser_verification", r"(?i)cf-browser-verification|cf_chl_opt|__cf_chl_"),
    ("cf_attention_required", r"(?i)attention required!\s*\|\s*cloudflare"),
    ("cf_checking_browser", r"(?i)checking your browser before accessing"),
    ("akamai_access_denied", r"(?is)access denied.{0,200}reference\s*#\d"),
    ("incapsula", r"(?i)request unsuccessful\.\s*incapsula incident"),
    ("distil_imperva", r"(?i)pardon our interruption"),
    ("perimeterx_challenge", r"(?i)px-captcha|_pxhd"),
    ("perimeterx", r"(?i)perimeterx"),
    ("datadome_challenge", r"(?i)captcha-delivery\.com"),
    ("datadome", r"(?i)datadome"),
    ("recaptcha_gate", r"(?i)g-recaptcha|hcaptcha\.com/captcha"),
    ("generic_bot_verification", r"(?i)<title>\s*bot verification"),
)
AMBIGUOUS = ("cf_just_a_moment", "perimeterx", "datadome", "recaptcha_gate")
GATE_TEXT = 200
CHALLENGE_HEADERS = (("cf-mitigated", ("challenge",)), ("x-amzn-waf-action", ("challenge", "captcha")), ("x-vercel-mitigated", ("challenge",)))
LOGIN_PATH = r"(?i)/(?:sign_?in|sign_?up|log_?in|log_?on|auth(?:orize)?|oauth|sso|account/login)(?:/|$|\?)"

# Wording of missing pages, looked for in the first 400 characters (512 or fewer: in all), and of missing deployments.
NOTFOUND_COPY = (
    ("page_not_found_en", r"(?i)\bpage not found\b"),
    ("not_found_bare", r"(?im)^\s*#?\s*not found\s*$"),
    ("does_not_exist", r"(?i)\b(?:page|this page)?\s*(?:does not|doesn'?t) exist\b"),
    ("no_longer_exists", r"(?i)\bno longer exists\b"),
    ("nothing_here", r"(?i)\b(?:nothing (?:to see )?here|there'?s nothing here)\b"),
    ("cannot_be_found", r"(?i)\b(?:could|couldn'?t|cannot|can'?t) (?:not )?be found\b"),
    ("http_404_title", r"(?i)\b404\b[^\d]{0,20}(?:not found|page not found|error)"),
    ("zh_page_missing", r"页面不存在|找不到页面|页面未找到|页面已删除|无法找到该页面"),
)
PLATFORM_MISSING = (
    ("vercel_deployment_not_found", r"(?i)DEPLOYMENT_NOT_FOUND|the deployment could not be found on vercel"),
    ("github_pages_missing", r"(?i)there isn'?t a github pages site here"),
    ("heroku_no_app", r"(?is)no such app\b.{0,80}herokuapp"),
    ("netlify_missing", r"(?i)not found\s*-\s*request id:\s*\w+"),
    ("nginx_default", r"(?i)welcome to nginx!"),
    ("fastly_unknown_domain", r"(?i)fastly error: unknown domain"),
    ("s3_nosuchbucket", r"(?i)<code>nosuchbucket</code>"),
)
LANDING_PATHS = ("", "/", "/hc/en-us", "/en-us", "/docs", "/docs/", "/docs/overview", "/docs/introduction", "/docs/get-started", "/home", "/index.html", "/payments/docs/overview")

# Anchor words by position class, and social hosts.
SALES_WORDS = (
    "talk to us", "talk to sales", "contact sales", "contact us", "get a demo", "book a demo", "request a demo", "schedule a call", "get a quote",
    "start free", "start for free", "free trial", "start trial", "sign up", "get started free", "buy now", "see pricing", "see plans", "see how",
    "upgrade", "联系销售", "预约演示", "免费试用", "立即购买", "咨询报价",
)
DOCS_WORDS = (
    "read the docs", "read docs", "documentation", "api reference", "api docs", "quickstart", "quick start", "get started", "view docs",
    "developer docs", "查看文档", "开发文档", "快速开始",
)
EXAMPLE_WORDS = (
    "example repository", "example repo", "sample code", "sample app", "view on github", "cookbook", "starter template", "boilerplate",
    "示例仓库", "示例代码",
)
SOCIAL_HOSTS = (
    "x.com twitter.com linkedin.com www.linkedin.com facebook.com www.facebook.com youtube.com www.youtube.com instagram.com www.instagram.com"
    " discord.com discord.gg join.slack.com reddit.com www.reddit.com mastodon.social bsky.app"
).split()

# What changes from request to request in a page's lower-cased text, the most specific first: time stamps, UUIDs, long hex,
# base64, epoch seconds, cache-busting queries.
VOLATILE = (
    r"\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:z|[+-]\d{2}:?\d{2})?",
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"\b[0-9a-f]{16,}\b",
    r"\b[A-Za-z0-9+/]{24,}={0,2}\b",
    r"\b1[6-9]\d{8,11}\b",
    r"[?&](?:v|ver|version|t|ts|hash|build|_)=[^\s\"'&]+",
)

# List-like elements, code elements, class words that a build makes up, class words of regions.
LIST_TAGS = frozenset({"ul", "ol", "nav", "table", "tbody", "dl", "menu"})
CODE_TAGS = frozenset({"code", "pre", "kbd", "samp"})
CLASS_HASH = r"^(?:[a-z]+[-_])?[0-9a-f]{5,}$|^css-[0-9a-z]+$|^[a-z]+[-_][a-z0-9]+__[a-z0-9]{5,}$"
PROMINENT_CLASSES = r"pricing|plan|tier|package|card|cta|hero|banner|nav|navbar|header|topbar|pill|button|btn"
FOOTER_CLASSES = r"footer|social|legal|copyright|colophon|bottom"
