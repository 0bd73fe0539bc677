"""Labelled lines for the credential model, made up from a grammar.

No table marks credentials, so the model is fitted to generated lines. A template gives the syntax
around a name and a value; the kinds of names and values decide the labels. Names, placeholders and sentences are put together from
parts. A fifth of the templates of each kind can be withheld from the training, so that accuracy is measured on
forms the model hasn't seen. The number of lines is a parameter of the training and bounds it.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable, Sequence

from lodesift.llm.secrets_lexer import tokens

_ALNUM = string.ascii_letters + string.digits
_LOWER = string.ascii_lowercase
#: One in so many templates is withheld where accuracy is measured.
WITHHELD = 5

# Ordinary words of names, passphrases and code.
WORDS = ("river", "anchor", "violet", "puzzle", "thunder", "meadow", "cactus", "orange", "barrel", "velcro", "sparrow", "granite", "oyster", "candle", "planet", "folder", "window", "engine", "signal", "market", "ticket", "camera", "bridge", "garden", "lemon", "harvest", "judge", "score", "patient", "invoice", "lesson", "voltage", "guitar", "parcel", "flight", "dragon", "compiler", "boarding", "rail", "keyboard", "monkey", "donkey", "tokenizer", "passage", "compass", "passenger", "secretary", "author", "authority", "key_frame", "keynote")
# What names of credentials end in, and what may stand before it.
ENDINGS = ("password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode", "secret", "token", "apikey", "api_key", "access_key", "secret_key", "private_key", "signing_key", "encryption_key", "master_key", "client_secret", "access_token", "auth_token", "refresh_token", "bearer_token", "api_token", "private_token", "shared_secret", "passwort", "kennwort", "contrasena", "clave", "senha", "wachtwoord", "haslo", "parola", "salasana")
OWNED = ("db", "app", "smtp", "ftp", "admin", "mail", "user", "service", "webhook", "proxy", "redis", "ldap", "prod", "stage", "test", "backup", "export", "legacy", "partner", "cache", "report")
# Names whose noun comes first.
NOUN_FIRST = tuple(f"{a}_{b}" for a in ("clave", "senha", "mot_de_passe", "contrasena", "token") for b in ("api", "app", "db", "admin", "service")) + ("mot_de_passe",)
CARRIERS = ("url", "broker", "dsn", "conn", "target", "database_url", "connection_string", "amqp_url", "redis_url", "source_url")
HEADERS = ("hdr", "auth_header", "session", "authorization", "auth", "header")
HOOKS = ("hook_url", "webhook", "webhook_url", "chat_hook")
CAPTIONS = ("label", "help", "error", "header_name", "hint", "name", "type", "policy", "file", "url", "field", "path", "id", "expiry", "min_length")
DIGESTS = ("checksum", "etag", "integrity", "content_hash", "commit", "sha256", "revision", "fingerprint", "digest", "file_hash")
IDS = ("trace_id", "request_id", "build_id", "tenant", "session_id", "user_id", "correlation_id", "db_request_id", "key_id", "token_id")
PUBLIC = ("cert", "public_pem", "public_key", "certificate", "ca_cert")
IMAGES = ("icon", "logo", "image", "avatar")
LINKS = ("docs_link", "url", "home_url", "reset_url", "target", "broker", "dsn", "login_url")
# Heads of issued tokens with the shortest and longest rest, and its characters.
ISSUED = (("sk_live_", 20, 38, _ALNUM), ("sk_test_", 20, 38, _ALNUM), ("ghp_", 36, 36, _ALNUM), ("gho_", 36, 36, _ALNUM), ("github_pat_", 22, 82, _ALNUM + "_"), ("glpat-", 20, 26, _ALNUM + "-_"), ("xoxb-", 24, 50, _ALNUM + "-"), ("AKIA", 16, 16, string.ascii_uppercase + string.digits), ("npm_", 36, 36, _ALNUM), ("pypi-", 40, 60, _ALNUM + "-_"), ("hf_", 30, 40, _ALNUM), ("SG.", 60, 70, _ALNUM))
ISSUERS = ("gitlab", "github", "npm", "pypi", "stripe", "slack", "sendgrid", "aws", "hugging_face")
# Parts of sentences about credentials that hold none.
ABOUT = ("password", "token", "api key", "secret", "pass", "passphrase", "access token", "signing key", "credentials")
HAPPENS = ("is required", "has expired", "was revoked", "must be longer", "could not be read", "does not match", "is checked twice", "belongs to {w}", "is rotated every {i} days", "gets lost after {w}", "is wrong", "may be empty", "comes from {w}", "needs {i} characters")
ASKS = ("Enter", "Repeat", "Choose", "Forgot", "Reset", "Type", "Confirm", "Invalid", "Missing", "New", "Your", "Unknown")


def _placeholder(r: random.Random) -> str:
    """A text that stands in for a value."""
    noun, verb = r.choice(("password", "token", "api_key", "secret", "key", "value")), r.choice(("set", "insert", "replace", "change", "add", "fill"))
    where = r.choice(("me", "here", "this", "later", "env", "ci", "vault"))
    body = r.choice((f"{verb}_{where}", f"{verb}_{noun}", f"your_{noun}", f"my_{noun}", f"{noun}_here", f"{noun}", f"from_{where}"))
    shaped = r.choice((body, body.upper(), body.replace("_", "-"), body.replace("_", "")))
    return r.choice(
        (
            f"<{shaped}>", f"__{body.upper()}__", "${" + body.upper() + "}", "$" + body.upper(), "{{ " + r.choice(WORDS) + "." + body + " }}", f"%({noun})s", f"[{shaped}]",
            f"your-{noun.replace('_', '-')}", f"YOUR_{noun.upper()}_HERE", f"{verb}me", f"{verb.upper()}_ME", r.choice("*xX") * r.randint(4, 20), "env:" + body.upper(), f"vault:{r.choice(WORDS)}/{noun}",
            r.choice(("TODO", "null", "example", "placeholder", "none", "dummy", "sample", "redacted", "hidden", "x")),
        )
    )


def _sentence(r: random.Random) -> str:
    """A caption or message about credentials."""
    about, w = r.choice(ABOUT), r.choice(WORDS)
    happens = r.choice(HAPPENS).format(w=w, i=r.randint(2, 99))
    text = r.choice((f"{r.choice(ASKS)} {about}", f"{about} {happens}", f"The {w} {about} {happens}", f"{about.capitalize()} {happens}, try again", f"{r.choice(ASKS)} your {about}?", f"X-{about.title().replace(' ', '-')}", f"{w} {about} {r.choice(WORDS)}", f"no {about} for {w}", about.replace(" ", "_") + "_" + w))
    return text


def _pick(r: random.Random, *kinds: Callable[[random.Random], str]) -> str:
    return r.choice(kinds)(r)


def _mixed(r: random.Random) -> str:
    extra = r.choice(("", "", "-_", "+/", "!#%*+=.", "&^%$!*", "=+", "-"))
    n = r.randint(8, 44)
    return "".join(r.choice(_ALNUM + extra) for _ in range(n)) + r.choice(("", "", "", "=", "=="))


def _wordnum(r: random.Random) -> str:
    a, b = r.choice(WORDS).split("_")[0], r.choice(WORDS).split("_")[0]
    if r.random() < 0.35:
        return f"{a}{r.randint(10, 9999)}"
    return f"{a.capitalize()}{r.choice('#*+=-!_%@$.&')}{b}{r.randint(10, 9999)}"


def _phrase(r: random.Random) -> str:
    return r.choice("--_.").join(r.choice(WORDS).split("_")[0] for _ in range(r.randint(3, 5)))


def _hex(r: random.Random, n: int | None = None) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n or r.choice((32, 40, 64))))


def _prefixed(r: random.Random) -> str:
    head = r.choice(("sk_live_", "sk_test_", "ghp_", "gho_", "glpat-", "xoxb-", "AKIA", "npm_", "pypi-", "hf_", "SG.", "".join(r.choice(_LOWER) for _ in range(3)) + r.choice(("_live_", "_pat_", "-", "_")), "".join(r.choice(string.ascii_uppercase) for _ in range(3)) + "."))
    tail = string.ascii_uppercase + string.digits if head == "AKIA" else _ALNUM
    return head + "".join(r.choice(tail) for _ in range(16 if head == "AKIA" else r.randint(18, 38)))


def _jwt(r: random.Random) -> str:
    head = base64.b64encode(b'{"alg": "HS256", "typ": "JWT"}').decode().rstrip("=")
    body = base64.b64encode(f'{{"sub": "svc{r.randint(1, 999)}", "exp": {r.randint(10**9, 2 * 10**9)}}}'.encode()).decode().rstrip("=")
    return f"{head}.{body}.{''.join(r.choice(_ALNUM + '-_') for _ in range(43))}"


def _secret(r: random.Random) -> str:
    return _pick(r, _mixed, _mixed, _wordnum, _wordnum, _phrase, _hex, _prefixed, _prefixed, _prefixed, _jwt if r.random() < 0.2 else _mixed)


def _short(r: random.Random) -> str:
    return r.choice((_wordnum(r), "".join(r.choice(_ALNUM + r.choice(("", "!*#.-_+="))) for _ in range(r.randint(8, 18)))))


def _uuid(r: random.Random) -> str:
    h = _hex(r, 32)
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def _block(r: random.Random, private: bool, join: str) -> str:
    kind = r.choice(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED ")) + "PRIVATE KEY" if private else r.choice(("PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY"))
    body = join.join("".join(r.choice(_ALNUM + "+/") for _ in range(64)) for _ in range(r.randint(1, 3)))
    if private and r.random() < 0.1:  # cut off
        return join.join((f"-----BEGIN {kind}-----", body))
    return join.join((f"-----BEGIN {kind}-----", body, f"-----END {kind}-----"))


def _host(r: random.Random) -> str:
    return f"{r.choice(('db1', 'mq', 'cache2', 'files', 'mail', 'hooks'))}.{r.choice(WORDS).replace('_', '-')}.{r.choice(('example', 'internal', 'test'))}"


def _marked(value: str) -> str:
    """A value that is a case, between marks."""
    return f"\x02{value}\x03"


def _address(r: random.Random) -> str:
    return f"{r.choice(('postgres', 'mysql', 'amqp', 'redis', 'https', 'mongodb', 'mysql+tcp', 'ftp'))}://{r.choice(('svc_', '')) + r.choice(WORDS)}:{_marked(_short(r))}@{_host(r)}{r.choice((':5432/main', ':6379/0', '/jobs', '/pull.git', '/app', ''))}"


def _connection(r: random.Random) -> str:
    pw = _marked(_short(r))
    return r.choice((f"host={_host(r)} user=app password={pw} sslmode=require", f"Server={_host(r)};Uid=svc;Pwd={pw};Pooling=true", f"Data Source={_host(r)};User ID=app;Password={pw};", f"Endpoint={_host(r)};SharedAccessKeyName=root;SharedAccessKey={pw}"))


def _hook(r: random.Random) -> str:
    return f"https://hooks.{r.choice(WORDS)}.example/services/T{''.join(r.choice(string.ascii_uppercase) for _ in range(8))}/{_marked(''.join(r.choice(_ALNUM) for _ in range(24)))}"


def _header(r: random.Random) -> str:
    basic = base64.b64encode(f"svc_{r.choice(WORDS)}:{_short(r)}".encode()).decode()
    jwt = _jwt(r)
    return r.choice((f"Basic {_marked(basic)}", f"Bearer {_marked(jwt)}", f"Authorization: Bearer {_marked(jwt)}", _marked(jwt), f"Bearer {_marked(_mixed(r))}", f"Authorization: Basic {_marked(basic)}", f"Authorization: token {_marked(_prefixed(r))}"))


def _link(r: random.Random) -> str:
    return r.choice((f"https://{_host(r)}/reset-password", f"https://{_host(r)}/login?next=token", f"postgres://{_host(r)}:5432/main", f"https://{_host(r)}/docs/api-key", f"redis://{_host(r)}:6379/0", f"https://{_host(r)}/v1/token?grant=password"))


def _pickt(r: random.Random, forms: Sequence[str], held: bool | None) -> str:
    """A template; ``held``: only of the withheld ones, or only of the others."""
    k = r.randrange(len(forms))
    while held is not None and (k % WITHHELD == WITHHELD - 1) != held:
        k = r.randrange(len(forms))
    return forms[k]


def _filled(form: str, **slots: object) -> str:
    """``form`` with ``@slot@`` replaced."""
    for k, v in slots.items():
        form = form.replace(f"@{k}@", str(v))
    return form


def _styled(r: random.Random, s: str) -> str:
    """A name in one of the usual spellings."""
    style = r.random()
    if style < 0.3:
        return s
    if style < 0.55:
        return s.upper()
    if style < 0.7:
        return s.replace("_", "-")
    parts = s.split("_")
    return parts[0] + "".join(p.capitalize() for p in parts[1:]) + r.choice(("", "", str(r.randint(1, 99999))))


def _credential(r: random.Random) -> str:
    """A name of what grants access."""
    if r.random() < 0.12:
        return _styled(r, r.choice(NOUN_FIRST))
    before = "" if r.random() < 0.45 else r.choice(OWNED) + "_" if r.random() < 0.8 else r.choice(WORDS) + "_"
    end = r.choice(ENDINGS)
    if end == "pass" and before[:-1] in WORDS:
        before = ""
    return _styled(r, before + end)


def _name(r: random.Random, stem: str) -> str:
    return _styled(r, ("" if r.random() < 0.6 else r.choice(OWNED) + "_") + stem)


# Notations that give a name (n) a value (v); q is a quote, i a number.
GIVEN = (
    "@n@ = @q@@v@@q@", "@n@ = @q@@v@@q@;", "const @n@ = @q@@v@@q@", "let @n@ = @q@@v@@q@;", "export const @n@ = @q@@v@@q@;", "const @n@ = `@v@`", "const @n@: string = @q@@v@@q@;",
    "export const opts@i@ = { user: 'app', @n@: '@v@' };", "OPTS_@i@ = { 'user': 'app', '@n@': '@v@' }", 'CONF_@i@ = {"host": "h1", "@n@": "@v@"}', '  "link@i@": {"user": "app", "@n@": "@v@"},', '  "@n@": "@v@",', '  "@n@": "@v@"',
    "process.env.@n@ = '@v@';", 'os.environ["@n@"] = "@v@"', 'os.environ.setdefault("@n@", "@v@")', 'client = connect(user="app", @n@="@v@")', "ENV['@n@'] ||= '@v@'", "ENV['@n@'] = '@v@'", "$@n@ = '@v@';",
    "$conf@i@ = ['user' => 'app', '@n@' => '@v@'];", "define('@n@', '@v@');", 'var conf@i@ = map[string]string{"@n@": "@v@"}', '@n@ := "@v@"', 'const @n@ = "@v@"', 'private static final String @n@ = "@v@";', 'String @n@ = "@v@";',
    '    static { System.setProperty("@n@", "@v@"); }', '    @Value("${a.b:@v@}") private String @n@;', 'static const char *@n@ = "@v@";', 'char @n@[] = "@v@";', '#define @n@ "@v@"', "@n@: @q@@v@@q@", "@n@: @v@", "  @n@: @v@", "@n@=@v@",
    "export @n@='@v@'", "export @n@=@v@", "ENV @n@=@v@", "ENV @n@ @v@", "ARG @n@=@v@", ': "${@n@:=z}" # @n@=@v@', ': "${@n@:=@v@}"', '@n@="${@n@:-@v@}"', '  default = "@v@" # @n@', '<add key="@n@" value="@v@"/>', '<property name="@n@" value="@v@" />',
    "<@n@>@v@</@n@>", "| @n@ | `@v@` |", "- @n@: @v@", "- name: @n@ # @v@", "-e @n@=@v@ \\", "# @n@: @v@", "// @n@ = @v@", "--@n@=@v@", "--@n@ @v@", "set @n@ @q@@v@@q@", "self.@n@ = @q@@v@@q@", "this.@n@ = @q@@v@@q@;", "@n@=@q@@v@@q@,",
    '.with("@n@", "@v@")', "puts @n@: '@v@'", "if @n@ == @q@@v@@q@:", 'return { @n@: "@v@" }',
)
# Prose and commands that quote a value; w and u are words, h a host, p a short value, a an address.
QUOTED = (
    "run with --token @v@", "run with --password @v@", "start --api-key @v@ --verbose", "@w@ pw is @v@ @t@", "the @w@ password is @v@ @t@", "password for @w@ is @v@", "temporary @k@ @v@ @t@", "use @v@ as the @k@ for @w@",
    "account @w@ / @v@", "login @w@ / @v@", "login: @w@_@u@ / @v@", "user @w@ password @v@", "user: @w@, password: @v@", "creds: @w@ / @v@ @t@", "@k@ changed to @v@", "my @k@ is @v@", "the @k@ used to be @v@ @t@",
    "mysql -u root -p@p@ main", "mysqldump -u @w@ -p@p@ shop > out.sql", "curl -u deploy:@v@ https://@h@/x", "curl -u @w@:@v@ https://@h@/x", "wget --user=@w@ --password=@v@ https://@h@/x", 'curl -H "X-Api-Key: @v@" https://@h@/x',
    'curl -H "Authorization: Bearer @v@" https://@h@/x', "ALTER USER @w@ IDENTIFIED BY @v@", "CREATE USER @w@ IDENTIFIED BY '@v@'", "GRANT ALL ON db TO @w@ IDENTIFIED BY '@v@'", "ALTER ROLE @w@ WITH PASSWORD '@v@'", "machine @h@ login svc password @v@",
    "git clone @a@", "sshpass -p @v@ ssh @w@@h@", "docker login -u @w@ -p @v@ @h@", "redis-cli -h @h@ -a @v@ ping", "password for @w@: @v@", "token: @v@", "@k@: @v@", "PGPASSWORD=@v@ psql -h @h@", "openssl enc -aes-256-cbc -k @v@", "@w@ @k@ = @v@ @t@", "@w@ @k@: @v@ @t@",
)
# Statements in which a name is assigned a value in two pieces (x).
IN_PIECES = ("@n@ = @q@@x@@q@", "const @n@ = @q@@x@@q@;", "var @n@ = @q@@x@@q@", "$@n@ = @q@@x@@q@;", "@n@ := @q@@x@@q@", "private String @n@ = @q@@x@@q@;", "  @q@@n@@q@: @q@@x@@q@,", "self.@n@ = @q@@x@@q@", "let @n@ = @q@@x@@q@", "export @n@=@q@@x@@q@")
# Statements that go on over line ends (g: end and indentation); v is a value, x one in pieces, y and z its pieces.
GOING_ON = (
    "@n@ =@g@@q@@v@@q@", "const @n@ =@g@@q@@v@@q@;", '"@n@":@g@"@v@",', "@n@ = (@g@@q@@v@@q@\n)", "@n@ = \\@g@@q@@v@@q@", "@n@: >@g@@v@", "@n@: |-@g@@v@", "@n@: |@g@@v@", "<@n@>@g@@v@\n</@n@>", "run --@m@ \\@g@@v@", "set(@g@@q@@n@@q@,@g@@q@@v@@q@\n)",
    "@n@ = @q@@x@@q@", "@n@ = @q@@x@@q@;", "@n@ = (@g@@q@@y@@q@@g@@q@@z@@q@\n)", "let @n@ =@g@@q@@v@@q@;",
)
# Code and prose without credentials; b and d are names of arguments, c one of a credential, W and U words in capitals, C a capitalised one.
PLAIN = (
    "for row in rows[:@i@]:", 'log.info("@w@_@u@ %s", @b@)', '@b@ = request.args.get("@w@", "@u@_@w@")', 'const @b@ = req.query.@w@ || "@u@";', "if @b@ is None:", 'raise ValueError("no @w@_pass given, id @i@")', 'throw new Error("@w@_pass not found");',
    "@w@_pass = fh.read()", "@w@_pass = int(@b@)", "@w@_pass: @i@", '"@w@_pass": "@u@",', '"@w@": "@u@ pass",', "int @w@_pass = @i@;", "char buf@i@[@i@];", "def parse_@w@_pass_@i@(@b@, limit=@i@):", "function load@C@Token@i@(@b@, next) {",
    "db.query(`SELECT @w@ FROM @u@ WHERE id = ${@b@}`);", 'cur.execute("SELECT @w@_key FROM @u@ WHERE id = " + @b@)', '@b@ = request.args.get("@w@_pass", "@u@_@w@")', 'const @b@ = req.query.@w@_pass || "@u@_@w@";', '$@b@ = $_GET["@w@_pass"] ?? "@u@_@w@";',
    '@b@ = params["@u@"] || "@w@_pass"', '$m@i@ = ["@w@_pass" => @i@, "@u@_@w@" => [1, 2]];', "@W@_PASS=@i@", "@W@_PASS=@u@", '@b@ := r.URL.Query().Get("@w@_pass")', 'String @b@ = request.getParameter("@w@_pass");', "{ name: '@w@', kind: '@u@_pass' }",
    '@c@ = os.environ["@W@_TOKEN"]', "@c@ = os.getenv('@W@_TOKEN')", "const @c@ = process.env.@W@_SECRET;", "@c@ = get_@w@_password(@b@)", "if not check_password(@b@, @c@):", "return @c@ == @b@", '@c@ = request.form["password"]', "@c@: string;", "@c@ = None", '@c@ = ""', "@c@ = ''",
    "@c@: null", "@c@ = @i@", "token = lexer.next_token()", "tokens = tokenizer.encode(text)", "for key, value in @w@.items():", "map.put(key, @i@);", '@app.route("/@w@_pass/@i@")', "app.get('/@w@_pass/:id', async (req, res) => {", "package @w@;", "import @w@.@u@.Token",
    'document.title = "@w@_pass " + @i@;', "let @w@OptKey@i@: string | undefined = undefined;", "const @w@Map@i@: Record<string, number> = { @w@_pass: @i@ };", 'Map<String, Integer> m@i@ = Map.of("@w@_pass", @i@);', 'fs.readFileSync("/srv/" + @b@);', 'subprocess.run(["@w@_pass", @b@], check=True)',
    '@w@="$(cat /srv/@u@.txt)"', 'printf("@w@_pass %d\\n", @i@);', "curl -u deploy https://@h@/x", "mysql -u root -p main", "docker run -p 8080:80 -v /srv:/srv @w@", "ssh -p 2222 @w@@h@", "- @w@_pass", "@w@: @u@_@w@_key", '{ "@w@": true, "author": "@u@" }', "class @C@Secret@i@:", "author: @w@ @u@",
    "@w@_pass = [@b@.@u@ for @b@ in @d@ if @b@]", "return [@b@ for @b@ in @d@ if @b@]", "    @w@_pass = [x.@u@ for x in @b@ if x]", "get '/@w@_@u@/@i@' do", "router.post('/@w@/@i@', @b@)", 'default = "@w@" # @u@', '@u@_header="$(cat /srv/@w@_header.txt)"', "require '@w@'", "const @w@PassMap@i@ = { @w@_pass: @i@, @u@: @d@ };",
    "@w@_@u@_@i@() {", "@w@_@u@() {", "function @w@_@u@_@i@ {", "def @w@_@u@_@i@(self):", "void @w@_@u@_@i@(void) {", "func @w@@C@@i@() {", "@w@_@u@_@i@", "@w@_@u@_@i@(@b@)",
    "@c@ = @b@.@u@()", "@c@=@b@.@u@(@i@)", "this.@c@ = @b@;", "self.@c@ = @b@.@u@", "let @c@ = @w@@C@(@b@);", "@w@.@c@=@b@.@u@();", "@c@=x.@u@();",
    "primary key is @w@_id", "@w@.@u@(@b@, @d@)", "return @b@.@w@ + @d@", "@b@ = @w@[@i@].@u@", "if (@b@ && @d@ < @i@) {", "} else {", "@w@ / @u@", "login: see @w@ / @u@", "account @w@ / @u@", "user: @w@, role: @u@",
)
# Statements as they stand in a line without blanks.
COMPACT = ("function @w@(a){return a+@i@}", "var @w@={a:@i@,b:[1,2,3]}", "@w@.push(e.@u@(n,i))", "if(@w@)@u@()", "for(;i<n;i++)@w@[i]=@u@(i)", "return!@w@.@u@", "@w@=@u@||{}", "else{@w@()}", "var @w@_pass=@i@", "@w@.token=t.next()", "try{@w@(e)}catch(x){}", "({@w@:@u@,key:@i@})")


def _compact(r: random.Random, held: bool | None) -> str:
    """Statements without blanks or line ends between them, some of which give a credential."""
    out = []
    for _ in range(r.randint(3, 9)):
        if r.random() < 0.12:
            out.append(f"{r.choice(('var ', 'let ', 'const ', ''))}{_credential(r).replace('-', '_')}={(q := r.choice(chr(34) + chr(39)))}{_marked(_secret(r))}{q}")
        else:
            out.append(_filled(_pickt(r, COMPACT, held), w=r.choice(WORDS), u=r.choice(WORDS), i=r.randint(0, 99)))
    return r.choice((";", ";", ";;")).join(out) + ";"


# Remarks about credentials or other keys, tokens and passes; s is a sentence about them.
REMARKS = (
    "@s@", "TODO: @s@", "@w@ @s@", "@s@ (@w@)", "the @w@ pass @e@ by @u@", "@w@ key and @u@ token @e@", "we pass @w@-@u@ on to @w@", "first pass over @w@, second pass over @u@", "this pass drops @w@ @u@ rows", "functions here pass @w@ @u@ through", "the token of the @w@ parser @e@", "keys of @w@ are sorted, then @e@",
    "each @w@ token @e@ in @u@", "a @w@ pass @e@", "pass the @w@ @u@ along", "FIXME @w@ key @e@ when @u@ is null", "see @w@.md for the @k@", "@k@ @e@, ask @w@", "the @k@ is in the vault under @w@", "@k@ is read from @w@", "login: ask @w@ or @u@", "login @e@ / @w@", "pass @w@, not @u@", "the @w@-key @e@", "no @k@ in @w@ please",
)


def _given(r: random.Random, name: str, value: str, held: bool | None) -> str:
    return _filled(_pickt(r, GIVEN, held), n=name, v=value, q=r.choice("\"\"'"), i=r.randint(1, 600))


def _tail(r: random.Random) -> str:
    return r.choice(("", "", "", "for now", f"on {r.choice(WORDS)}", f"since {r.randint(1, 30)} May", f"({r.choice(WORDS)})", f"till {r.choice(WORDS)} is back", f"and {r.choice(WORDS)} {r.choice(WORDS)}", f"until {r.choice(WORDS)} {r.choice(WORDS)}"))


def _event(r: random.Random) -> str:
    """A verb with what goes with it, of ordinary words."""
    verb = r.choice(("is", "was", "gets", "can be", "must be", "isn't"))
    done = r.choice(("checked", "moved", "sorted", "limited", "shared", "built", "merged", "renamed", "counted", "skipped", "cached", "needed", "shown", "kept", "split"))
    return f"{verb} {done}{r.choice(('', ' twice', f' in {r.choice(WORDS)}', f' after {r.choice(WORDS)}', ', sorry', f' with {r.choice(WORDS)}'))}"


_COMMENT = ("# ", "// ", "/* ", "-- ", "", "; ", "* ", "<!-- ")


def _quoted(r: random.Random, held: bool | None) -> str:
    """A line of prose or command that quotes a credential."""
    form = _pickt(r, QUOTED, held)
    kind = r.choice(("password", "passphrase", "api key", "token", "secret", "access key", "pw"))
    return r.choice(_COMMENT) + _filled(form, v=_marked(_secret(r)), w=r.choice(WORDS), u=r.choice(WORDS), h=_host(r), p=_marked(_short(r)), a=_address(r), t=_tail(r), k=kind).rstrip()


def _pieces(r: random.Random, held: bool | None) -> str:
    v = _secret(r)
    k = r.randint(len(v) // 3 + 1, 2 * len(v) // 3)
    q, join = r.choice("\"'"), r.choice((" + ", " . ", " ", " .. ", " <> ", " & "))
    return _filled(_pickt(r, IN_PIECES, held), x=f"{_marked(v[:k])}{q}{join}{q}{_marked(v[k:])}", n=_credential(r), q=q)


def _unnamed(r: random.Random, held: bool | None) -> str:
    """A token of a known issuer, which its shape alone makes a credential."""
    head, low, high, chars = r.choice(ISSUED)
    v = _marked(head + "".join(r.choice(chars) for _ in range(r.randint(low, high))))
    if head == "SG.":
        v = _marked(f"SG.{''.join(r.choice(_ALNUM + '-_') for _ in range(22))}.{''.join(r.choice(_ALNUM + '-_') for _ in range(43))}")
    w = r.choice(WORDS)
    n = r.choice((w, w.upper(), *ISSUERS, r.choice(ISSUERS).upper(), f"{w}_{r.choice(ISSUERS)}"))
    return r.choice((v, f"- {v}", f'"{v}",', f"'{v}'", f"# {v}", f"see {w}: {v}", f"use {v} for {w}", f"{n} {v}", _given(r, n, v, held), _given(r, n, v, held), _given(r, n, v, held)))


def _broken(r: random.Random, held: bool | None) -> str:
    """A statement that goes on over line ends."""
    n, q, gap = _credential(r), r.choice("\"'"), "\n" + " " * r.randint(2, 12)
    if r.random() < 0.25:
        return r.choice(("@n@ =@g@@q@@v@@q@", '"@n@":@g@"@v@"', "@n@ = (@g@@q@@v@@q@\n)")).replace("@n@", n).replace("@g@", gap).replace("@q@", q).replace("@v@", r.choice((_placeholder, _sentence))(r))
    whole = _secret(r)
    k = r.randint(len(whole) // 3 + 1, 2 * len(whole) // 3)
    a, b = _marked(whole[:k]), _marked(whole[k:])
    join = r.choice((f"{q} +{gap}{q}", f"{q}{gap}+ {q}", f"{q} .{gap}{q}", f"{q}{gap}. {q}", f"{q} \\{gap}{q}"))
    return _filled(_pickt(r, GOING_ON, held), x=a + join + b, y=a, z=b, v=_marked(whole), n=n, m=n.replace("_", "-"), q=q, g=gap)


def _plain(r: random.Random, held: bool | None) -> str:
    """A line of code without credentials, though its names may look like one."""
    w, u = r.choice(WORDS), r.choice(WORDS)
    b, d = (f"{r.choice(('arg', 'val', 'x', 'in'))}_{r.choice(WORDS)[:6]}{r.choice(('', str(r.randint(1, 150))))}" for _ in range(2))
    return _filled(_pickt(r, PLAIN, held), w=w, u=u, b=b, d=d, c=_credential(r), W=w.upper(), C=w.capitalize(), i=r.randint(1, 9999), h=_host(r))


def _remark(r: random.Random, held: bool | None) -> str:
    form = _pickt(r, REMARKS, held)
    return r.choice(_COMMENT) + _filled(form, s=_sentence(r), e=_event(r), k=r.choice(ABOUT), w=r.choice(WORDS).split("_")[0], u=r.choice((r.choice(WORDS).split("_")[0], "up", "in", "off", "on")))


def _line(r: random.Random, held: bool | None) -> str:
    y = r.random()
    if y < 0.05:
        return _unnamed(r, held)
    if y < 0.10:
        return _broken(r, held)
    if y < 0.12:
        return _compact(r, held)
    x = r.random()
    if x < 0.27:
        return _given(r, _credential(r), _marked(_secret(r)), held)
    if x < 0.34:
        return _given(r, _name(r, r.choice(CARRIERS)), r.choice((_address, _connection))(r), held)
    if x < 0.40:
        return _given(r, _name(r, r.choice(HEADERS)), _header(r), held)
    if x < 0.43:
        return _given(r, _name(r, r.choice(HOOKS)), _hook(r), held)
    if x < 0.45:
        return _given(r, _name(r, r.choice(("pem", "key", "private_key", "ssh_key"))), _marked(_block(r, True, r.choice(("\\n", "\n", " ")))), held)
    if x < 0.52:
        return _quoted(r, held)
    if x < 0.55:
        return _pieces(r, held)
    if x < 0.62:
        return _given(r, r.choice((_credential(r), _name(r, r.choice(HEADERS)))), _placeholder(r), held)
    if x < 0.66:
        return _given(r, _styled(r, f"{r.choice(ENDINGS)}_{r.choice(CAPTIONS)}"), _sentence(r), held)
    if x < 0.70:
        return _given(r, _name(r, r.choice(DIGESTS)), r.choice((_hex(r), "sha512-" + _mixed(r) + _mixed(r), "sha256:" + _hex(r, 64))), held)
    if x < 0.73:
        return _given(r, _name(r, r.choice(IDS)), r.choice((_uuid(r), _hex(r, 24), str(r.randint(1, 10**9)))), held)
    if x < 0.75:
        return _given(r, _name(r, r.choice(PUBLIC)), _block(r, False, r.choice((" ", "\\n"))), held)
    if x < 0.77:
        return _given(r, _name(r, r.choice(IMAGES)), "data:image/png;base64," + "".join(r.choice(_ALNUM + "+/") for _ in range(60)), held)
    if x < 0.80:
        return _given(r, _name(r, r.choice(LINKS)), _link(r), held)
    if x < 0.84:
        return _given(r, _name(r, r.choice(WORDS)), r.choice((_phrase(r), r.choice(WORDS), _wordnum(r), str(r.randint(1, 9999)), _hex(r, 40))), held)
    return _plain(r, held) if x < 0.94 else _remark(r, held)


def labelled(n: int, seed: int, held: bool | None = None) -> list[tuple[str, list[tuple[int, int]]]]:
    """``n`` lines with the spans of their cases; ``held``: from the withheld templates only, or from the others only."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        marked = "    " * r.choice((0, 0, 0, 1, 2)) + _line(r, held)
        line, spans, at, start = [], [], 0, 0
        for c in marked:
            if c == "\x02":
                start = at
            elif c == "\x03":
                spans.append((start, at))
            else:
                line.append(c)
                at += 1
        out.append(("".join(line), spans))
    return out


def tagged(n: int, seed: int, name_of: Callable[[str], tuple[str, str]], held: bool | None = None) -> tuple[list[list], list[list[str]], list[str], int]:
    """Token sequences with labels ``S`` (a case), ``K`` (the name of one) and ``O``, their lines, and the cases no token fits."""
    seqs, tags, lines, unfit = [], [], [], 0
    for line, spans in labelled(n, seed, held):
        toks = tokens(line)
        at = {(t.start, t.end) for t in toks}
        if any(s not in at for s in spans):
            unfit += 1
            continue
        hit = set(spans)
        seqs.append(toks)
        tags.append(["S" if (t.start, t.end) in hit else "K" if name_of(t.text)[0] in ("cred", "carrier") else "O" for t in toks])
        lines.append(line)
    return seqs, tags, lines, unfit
