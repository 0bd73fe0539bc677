"""The built-in line rules, in the rule format of ``operators.rules``; larger tables are loaded from files."""

from __future__ import annotations

from lodesift.operators.rules import Rule, parse

_A01, _A02, _A03, _A05, _A07, _A08 = "A01:2021", "A02:2021", "A03:2021", "A05:2021", "A07:2021", "A08:2021"


def _r(rule_id: str, name: str, severity: str, languages: str, cwe: str, owasp: str, *patterns: str | tuple[str, str], **more: object) -> Rule:
    listed = [p if isinstance(p, str) else dict(zip(("regex", "confidence", "language", "severity"), p)) for p in patterns]
    return parse({"id": rule_id, "name": name, "severity": severity, "languages": languages.split(), "cwe": cwe, "owasp": owasp, "patterns": listed, "tags": [rule_id.removeprefix("OWN-").split("-")[0].lower()], **more})


# Ids, severities, languages, weaknesses and patterns of the rules.
RULES = [
    _r("PY-001", "SubprocessShellInjection", "critical", "python", "CWE-78", _A03, (r"subprocess\.(?:Popen|call|run|check_output|check_call)\s*\([^)]*shell\s*=\s*True", "high"), (r"""subprocess\.(?:Popen|call|run|check_output|check_call)\s*\(\s*f["']""", "high"), (r"subprocess\.(?:Popen|call|run|check_output|check_call)\s*\([^)]*\.format\s*\(", "high"), (r"subprocess\.(?:Popen|call|run|check_output|check_call)\s*\([^)]*%\s*[(\w]", "high"), (r'subprocess\.(?:Popen|call|run|check_output|check_call)\s*\(\s*(?:[a-zA-Z_]\w*\s*\+|"[^"]*"\s*\+)', "high")),
    _r("PY-002", "PathTraversal", "high", "python", "CWE-22", _A01, (r"os\.path\.join\s*\(", "medium"), guards=[r"request\.|input\(|sys\.argv"], near=[{"pattern": r"request\.|user_input|filename|file_name|filepath|user_file", "before": 3, "after": 3}]),
    _r("PY-003", "JinjaAutoescapeDisabled", "high", "python", "CWE-79", _A03, (r"Environment\s*\([^)]*autoescape\s*=\s*(?:False|0)", "high"), (r"Environment\s*\(", "medium"), near_none=[{"pattern": r"autoescape\s*=\s*(?:True|select_autoescape|1)", "before": 3, "after": 3}], guards=[r"jinja2"]),
    _r("PY-004", "UnsafeYAMLLoad", "critical", "python", "CWE-502", _A08, (r"yaml\.(?:load|unsafe_load)\s*\(", "high"), near_none=[{"pattern": r"Loader\s*=\s*(?:yaml\.)?(?:SafeLoader|CSafeLoader|FullLoader|CFullLoader)", "before": 0, "after": 3}], line_none=[r"yaml\.safe_load\s*\("]),
    _r("PY-005", "TempfileMktemp", "medium", "python", "CWE-377", _A01, (r"tempfile\.mktemp\s*\(", "high")),
    _r("PY-007", "UnsafeDeserialization", "critical", "python", "CWE-502", _A08, (r"(?:pickle|cPickle|dill|cloudpickle|shelve|marshal)\.(?:load|loads)\s*\(", "high")),
    _r("PY-008", "TimingAttack", "medium", "python", "CWE-208", _A02, (r"""(?:token|secret|api_key|password_hash|signature|hmac|digest|hash_value)\s*(?:==|!=)\s*(?:[a-zA-Z_]\w*|["'])""", "medium"), guards_none=[r"hmac\.compare_digest", r"secrets\.compare_digest"]),
    _r("PY-010", "FlaskHardcodedSecret", "high", "python", "CWE-798", _A07, (r"""(?:SECRET_KEY|secret_key)\s*=\s*["'][^"']+["']""", "high"), line_none=[r"os\.(?:environ|getenv)"]),
    _r("PY-011", "TLSVerificationDisabled", "high", "python", "CWE-295", _A02, (r"requests\.(?:get|post|put|delete|patch|head|options|request)\s*\([^)]*verify\s*=\s*False", "high"), (r"urllib3\.disable_warnings\s*\(", "medium"), (r"ssl\._create_unverified_context", "high"), (r"httpx\.(?:Client|AsyncClient)\s*\([^)]*verify\s*=\s*False", "high")),
    _r("PY-013", "UnsafeArchiveExtraction", "high", "python", "CWE-22", _A01, (r"\.extractall\s*\(", "medium"), guards=[r"tarfile|zipfile"], near_none=[{"pattern": r"filter\s*=|members\s*=", "before": 0, "after": 2}]),
    _r("PY-014", "LoggingInjection", "low", "python", "CWE-117", "A09:2021", (r"""(?:logging|logger|log)\.(?:debug|info|warning|error|critical|exception)\s*\(\s*f["']""", "low")),
    _r("PY-016", "DebuggerInProduction", "critical", "python", "CWE-489", _A05, (r"(?:run_simple|serve)\s*\([^)]*use_debugger\s*=\s*True", "high"), (r"app\.run\s*\([^)]*debug\s*=\s*True", "high"), (r"DebugToolbarExtension\s*\(", "medium")),
    _r("PY-018", "AsyncioShellInjection", "critical", "python", "CWE-78", _A03, (r"asyncio\.create_subprocess_shell\s*\(", "medium")),
    _r("CTR-001", "DockerRunAsRoot", "medium", "dockerfile", "CWE-250", _A05, (r"(?i)^USER\s+root\b", "high"), (r"(?i)^FROM\s+", "medium"), guards_none=[r"(?im)^USER\s+(?:[a-qs-z0-9]\S*|r(?:[a-np-z]\S*)?)$"], once=True),
    _r("CTR-002", "DockerCopyWildcard", "medium", "dockerfile", "CWE-200", _A05, (r"(?i)^(?:COPY|ADD)\s+(?:\.\s|\./\s|\*\s|\.\.\s)", "medium")),
    _r("CTR-003", "DockerLatestTag", "low", "dockerfile", "CWE-829", "A06:2021", (r"(?i)^FROM\s+\S+:latest\b", "high"), (r"(?i)^FROM\s+([a-z0-9._/-]+)\s*$", "medium"), line_none=[r"(?i)^FROM\s+\S+@sha256:", r"(?i)^FROM\s+scratch\b"]),
    _r("CTR-004", "DockerExposeSSH", "medium", "dockerfile", "CWE-284", _A05, (r"(?i)^EXPOSE\s+.*\b22\b", "high")),
    _r("CTR-005", "DockerPrivileged", "high", "dockerfile yaml shell *", "CWE-250", _A05, (r"(?i)--privileged", "high"), (r"(?i)--cap-add\s*=?\s*(?:ALL|SYS_ADMIN|SYS_PTRACE|NET_ADMIN)", "high")),
    _r("CTR-006", "DockerSecretsInEnv", "high", "dockerfile", "CWE-798", _A07, (r"(?i)^(?:ENV|ARG)\s+\S*(?:PASSWORD|SECRET|TOKEN|KEY|CREDENTIAL|API_KEY|PRIVATE_KEY|AWS_SECRET|DB_PASS)\s*=\s*\S+", "high")),
    _r("CTR-007", "K8sPrivilegedContainer", "high", "yaml *", "CWE-250", _A05, (r"(?i)privileged\s*:\s*true", "high"), (r"(?i)allowPrivilegeEscalation\s*:\s*true", "medium"), guards=[r"(?i)containers\s*:"]),
    _r("CTR-008", "K8sHostNamespace", "high", "yaml *", "CWE-250", _A05, (r"(?i)hostNetwork\s*:\s*true", "high"), (r"(?i)hostPID\s*:\s*true", "high"), (r"(?i)hostIPC\s*:\s*true", "high")),
    _r("CTR-009", "K8sNoResourceLimits", "medium", "yaml *", "CWE-770", _A05, (r"(?i)containers\s*:", "medium"), guards_none=[r"(?i)limits\s*:"], once=True),
    _r("CTR-010", "TerraformOpenIngress", "high", "terraform", "CWE-284", _A05, (r"""(?i)(?:cidr_blocks|cidr_ipv6)\s*=\s*\[\s*["'](?:0\.0\.0\.0/0|::/0)["']""", "high"), guards=[r"""(?i)(?:resource\s+["']aws_security_group|ingress\s*\{)"""]),
    _r("CRY-001", "WeakHashing", "high", "go python javascript typescript java", "CWE-328", _A02, (r"\bmd5\.(New|Sum)\b", "high"), (r"\bsha1\.(New|Sum)\b", "medium"), (r"\bhashlib\.(?:md5|sha1)\s*\(", "high"), (r"""\bhashlib\.new\s*\(\s*["'](?:md5|sha1)["']""", "high"), (r"""crypto\.createHash\s*\(\s*['"](?:md5|sha1)['"]""", "high"), (r"""MessageDigest\.getInstance\s*\(\s*"(?:MD5|SHA-?1)\"""", "high")),
    _r("CRY-002", "InsecureRandom", "medium", "go python javascript typescript", "CWE-338", _A02, (r"\brand\.(Int|Intn|Float|Read|New)\b", "medium"), (r"\brandom\.(random|randint|choice|randrange|getrandbits)\s*\(", "medium"), (r"\bMath\.random\s*\(", "medium"), near=[{"pattern": r"(?i)(token|session|password|secret|nonce|otp|csrf|key|salt|iv|auth|uuid|encrypt|hash|credential|certificate)", "before": 2, "after": 2}]),
    _r("CRY-003", "WeakCipher", "high", "go python java", "CWE-327", _A02, (r"\bdes\.(NewCipher|NewTripleDESCipher)\b", "high"), (r"\brc4\.NewCipher\b", "high"), (r"\bDES(3)?\.new\s*\(", "high"), (r"\bARC4\.new\s*\(", "high"), (r"""Cipher\.getInstance\s*\(\s*"(?:DES|RC4|ARCFOUR)""", "high")),
    _r("CRY-004", "FixedIV", "high", "*", "CWE-329", _A02, (r"(?i)\b(iv|nonce)\s*[:=]+\s*\[\]byte\s*\{", "high"), (r"""(?i)\b(iv|nonce|initialization.?vector)\s*[:=]\s*["']""", "medium"), (r"(?i)\b(iv|nonce)\s*=\s*\[\s*0x", "high")),
    _r("CRY-005", "InsecureTLS", "high", "*", "CWE-295", _A02, (r"InsecureSkipVerify\s*:\s*true", "high"), (r"rejectUnauthorized\s*:\s*false", "high"), (r"""NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0['"]?""", "high"), (r"ssl\._create_unverified_context|CERT_NONE", "high")),
    _r("CRY-006", "WeakKeySize", "high", "*", "CWE-326", _A02, (r"rsa\.GenerateKey\s*\([^,]+,\s*(512|768|1024)\s*\)", "high"), (r"(?i)(?:key[_\s-]?(?:size|length|bits)|bits)\s*[:=]\s*(512|768|1024)\b", "medium"), (r"(?:initialize|KeyPairGenerator)\s*\(\s*(512|768|1024)\s*\)", "high")),
    _r("CRY-007", "PlaintextProtocol", "low", "*", "CWE-319", _A02, (r"""["']http://[^"'\s]+["']""", "low"), line_none=[r"http://(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])", r"http://(example\.com|example\.org|test\.)"]),
    _r("CRY-011", "PredictableSeed", "high", "python c java go php ruby", "CWE-335", _A02, (r"\brandom\.seed\s*\(\s*(time|int\s*\(\s*time|datetime)", "high"), (r"\bsrand\s*\(\s*time\s*\(", "high"), (r"\.setSeed\s*\(\s*(System\.currentTimeMillis|System\.nanoTime|new\s+Date)", "high"), (r"\brand\.Seed\s*\(\s*time\.", "high"), (r"\bsrand\s*\(\s*\d+\s*\)", "medium")),
    _r("CRY-013", "UnauthenticatedEncryption", "medium", "go python java javascript typescript", "CWE-353", _A02, (r"cipher\.NewCBC(Encrypter|Decrypter)\b", "medium"), (r"""AES\.MODE_CBC|mode\s*=\s*['"]CBC['"]""", "medium"), (r"""Cipher\.getInstance\s*\(\s*["']AES/CBC/""", "medium"), guards_none=[r"(?i)(hmac|mac|tag|gcm|poly1305|authenticate|verify_mac|verify_tag|AEAD|GCM|CCM)"]),
    _r("JWT-001", "JWTNoneAlgorithm", "critical", "*", "CWE-347", _A02, (r"""(?i)["'](?:alg|algorithm)["']\s*[=:]\s*["']none["']""", "high"), (r"""(?i)algorithms?\s*[=:]\s*\[?\s*["']none["']""", "high")),
    _r("JWT-002", "JWTHardcodedSecret", "high", "*", "CWE-798", _A07, (r"""(?i)(?:jwt\.(?:sign|encode|create)|jsonwebtoken\.sign)\s*\([^,]+,\s*["'][^"']{1,100}["']""", "high"), (r"""(?i)(?:jwt_secret|jwt_key|secret_key|signing_key|token_secret)\s*[=:]\s*["'][^"']{1,100}["']""", "medium"), line_none=[r"(?i)process\.env|os\.environ|getenv"]),
    _r("JWT-004", "JWTNoExpiry", "medium", "*", "CWE-613", _A07, (r"(?i)(?:verify_exp\s*[=:]\s*false|ignore_?expiration\s*[=:]\s*true)", "high")),
    _r("JWT-007", "JWTInURL", "medium", "*", "CWE-598", _A07, (r"(?i)(?:\?|&)(?:token|jwt|access_token|id_token|auth_token)\s*=\s*(?:eyJ|\w+\.ey)", "high"), (r"""(?i)(?:url|uri|href|redirect|link)\s*[=+:]\s*[^;]*[?&](?:token|jwt|access_token)=""", "medium")),
    _r("JWT-010", "JWTLocalStorage", "medium", "javascript typescript", "CWE-922", _A02, (r"""(?i)localStorage\.setItem\s*\(\s*["'](?:token|jwt|access_token|id_token|auth_token|refresh_?token)["']""", "high")),
    _r("AUTH-001", "HardcodedCredentialCheck", "critical", "go python javascript typescript php ruby java csharp", "CWE-798", _A07, (r"""(?i)\b(?:password|passwd|pwd|secret)\s*(?:==|===|!=|!==)\s*["'][^"']{3,}["']""", "high")),
]


# Ids, severities, languages, weaknesses and patterns of the rules for single languages.
RULES += [
    _r("PHP-001", "TypeJuggling", "high", "php", "CWE-697", _A07, (r"(?:password|token|secret|hash|key|auth|session|nonce|csrf|otp|pin|code|digest|signature|mac|hmac)\s*(?:==|!=)\s*", "high"), line_none=[r"===|!=="]),
    _r("PHP-002", "SSRF", "high", "php", "CWE-918", "A10:2021", (r"\bfile_get_contents\s*\(\s*\$", "medium"), (r"\bfopen\s*\(\s*\$", "medium"), (r"\bcurl_setopt\s*\([^,]+,\s*CURLOPT_URL\s*,\s*\$", "medium"), near=[{"pattern": r"\$_(?:GET|POST|REQUEST|COOKIE)", "before": 15, "after": 4}], line_none=[r"__DIR__|dirname|__FILE__|realpath"]),
    _r("PHP-003", "FileInclusion", "critical", "php", "CWE-98", _A03, (r"\b(?:include|include_once|require|require_once)\s*\(?\s*\$(?:_GET|_POST|_REQUEST|_COOKIE|input|param|file|page|path|dir|template|module|lang|language)", "high"), (r"""\b(?:include|include_once|require|require_once)\s*\(?\s*["'][^"']*["']\s*\.\s*\$""", "medium")),
    _r("PHP-004", "MailHeaderInjection", "high", "php", "CWE-93", _A03, (r"\bmail\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)", "high")),
    _r("PHP-005", "CommandInjection", "critical", "php", "CWE-78", _A03, (r"\b(?:system|exec|passthru|shell_exec|popen|proc_open|pcntl_exec)\s*\(\s*\$(?:_GET|_POST|_REQUEST|_COOKIE|input|cmd|command|param|arg)", "high"), (r"`[^`]*\$(?:_GET|_POST|_REQUEST|_COOKIE|input|cmd|command)", "high"), line_none=[r"escapeshellarg|escapeshellcmd"]),
    _r("PHP-006", "RawSQLQuery", "critical", "php", "CWE-89", _A03, (r"""\b(?:mysqli_query|mysql_query|pg_query|pg_exec)\s*\(\s*\$\w+\s*,\s*(?:"[^"]*\$|'[^']*'\s*\.\s*\$)""", "high"), (r'\b(?:mysqli_query|mysql_query|pg_query|pg_exec)\s*\([^,]+,\s*"[^"]*"\s*\.\s*\$', "high")),
    _r("PHP-007", "InsecureSessionCookie", "medium", "php", "CWE-614", _A05, (r"(?i)session\.cookie_(?:httponly|secure)\s*=\s*(?:0|false|off)", "high"), (r"""\bini_set\s*\(\s*["']session\.cookie_(?:httponly|secure)["']\s*,\s*["']?(?:0|false)""", "high")),
    _r("PHP-008", "SymfonyProcessInjection", "critical", "php", "CWE-78", _A03, (r"Process::fromShellCommandline\s*\(\s*\$", "high"), (r"new\s+Process\s*\(\s*\[?\s*\$", "medium")),
    _r("PHP-009", "TwigRawFilter", "high", "php *", "CWE-79", _A03, (r"\{\{[^}]*\|\s*raw\b", "medium"), (r"\{%[-\s]*autoescape\s+false\s*[-\s]*%\}", "high"), (r"'autoescape'\s*=>\s*false", "high")),
    _r("PHP-010", "LDAPInjection", "high", "php", "CWE-90", _A03, (r"""\bldap_search\s*\([^,]+,\s*[^,]+,\s*(?:\$|["'][^"']*["']\s*\.\s*\$)""", "medium"), guards_none=[r"ldap_escape\s*\("]),
    _r("PHP-011", "WeakRandom", "medium", "php", "CWE-338", _A02, (r"\b(?:rand|mt_rand|array_rand|shuffle|str_shuffle)\s*\(", "medium"), near=[{"pattern": r"(?i)(?:token|password|secret|key|nonce|csrf|otp|salt|iv|session|reset|verify|auth)", "before": 5, "after": 5}], near_none=[{"pattern": r"\b(?:random_int|random_bytes|openssl_random_pseudo_bytes)\s*\(", "before": 5, "after": 5}]),
    _r("PHP-012", "DisplayErrors", "medium", "php", "CWE-209", _A05, (r"""\bini_set\s*\(\s*["']display_errors["']\s*,\s*["']?(?:1|true|[oO]n)""", "high"), (r"(?i)^\s*display_errors\s*=\s*(?:1|on|true)", "high")),
    _r("RB-001", "ERBUnescapedOutput", "high", "ruby", "CWE-79", _A03, (r"\braw\s*\(\s*(?:params|request|session|cookies|@\w+)", "high"), (r"(?:params|request|session|cookies|@\w+)\s*(?:\[.*\])?\s*\.html_safe", "high"), (r'"[^"]*#\{[^}]*\}[^"]*"\s*\.html_safe', "medium")),
    _r("RB-002", "RubyCommandInjection", "critical", "ruby", "CWE-78", _A03, (r"""\b(?:system|exec)\s*\(\s*["'][^"']*#\{\s*(?:params|request|session|cookies)""", "high"), (r"\b(?:system|exec)\s*\(\s*(?:params|request|ARGV)", "high"), (r"`[^`]*#\{\s*(?:params|request|session|ARGV)", "high")),
    _r("RB-003", "YAMLUnsafeLoad", "critical", "ruby", "CWE-502", _A08, (r"\bYAML\.load\s*\(", "high"), (r"\bYAML\.load_file\s*\(", "medium"), line_none=[r"\bYAML\.safe_load"]),
    _r("RB-004", "ParamsInQuery", "critical", "ruby", "CWE-89", _A03, (r"""(?:execute|query|where|find_by_sql|select|from|order|group|having)\s*\(\s*["'].*#\{\s*params\s*\[""", "high")),
    _r("RB-005", "KernelOpenPipe", "high", "ruby", "CWE-78", _A03, (r"\bopen\s*\(\s*(?:params|request|ARGV|gets|readline)", "high"), (r"""\bopen\s*\(\s*["']\|""", "high"), (r"\bURI\.open\s*\(\s*(?:params|request|ARGV|gets)", "high")),
    _r("RB-006", "SendMethodInjection", "high", "ruby", "CWE-94", _A03, (r"\b(?:send|public_send|__send__)\s*\(\s*(?:params|request|session|cookies)\s*\[", "high")),
    _r("RB-007", "RegexpInjection", "medium", "ruby", "CWE-1333", _A03, (r"\bRegexp\.(?:new|compile)\s*\(\s*(?:params|request|session|cookies|gets|readline)", "high")),
    _r("RB-008", "InsecureSSL", "high", "ruby", "CWE-295", _A02, (r"verify_mode\s*=\s*OpenSSL::SSL::VERIFY_NONE", "high"), (r"verify_peer\s*[:=]\s*false", "high")),
    _r("RB-009", "MarshalUnsafeLoad", "critical", "ruby", "CWE-502", _A08, (r"\bMarshal\.(?:load|restore)\s*\(", "high"), line_none=[r"\bMarshal\.(?:load|restore)\s*\(\s*(?:File\.read|IO\.read|File\.open)"]),
    _r("RB-010", "MassAssignment", "high", "ruby", "CWE-915", _A08, (r"\.update_attributes?\s*\(\s*params", "high"), (r"\.(?:new|create)\s*\(\s*params\s*(?:\[|\))", "medium"), line_none=[r"\.permit\b"]),
    _r("RB-011", "OpenRedirect", "high", "ruby", "CWE-601", _A01, (r"\bredirect_to\s+(?:params|request\.referer|URI\s*\()", "high"), (r"""\bredirect_to\s+["'][^"']*#\{\s*params""", "high")),
    _r("JAVA-001", "JNDIInjection", "critical", "java", "CWE-74", _A03, (r'\.lookup\s*\(\s*"[^"]*"\s*\+', "high"), (r"\.lookup\s*\(\s*[a-zA-Z_]\w*", "medium"), guards=[r"(?:InitialContext|DirContext|LdapContext)"]),
    _r("JAVA-002", "ELInjection", "critical", "java", "CWE-917", _A03, (r"""\.create(?:Value|Method)Expression\s*\(\s*[^"'\s)]""", "medium"), (r'\.createValueExpression\s*\([^)]*"[^"]*"\s*\+', "high")),
    _r("JAVA-003", "SpELInjection", "critical", "java", "CWE-917", _A03, (r'\.parseExpression\s*\(\s*"[^"]*"\s*\+', "high"), (r"\.parseExpression\s*\(\s*[a-zA-Z_]\w*", "medium"), guards=[r"SpelExpressionParser"]),
    _r("JAVA-004", "HQLInjection", "critical", "java", "CWE-89", _A03, (r'\.createQuery\s*\(\s*"[^"]*"\s*\+', "high"), (r"\.createQuery\s*\(\s*[a-zA-Z_]\w*\s*\+", "high"), guards_none=[r"CriteriaBuilder|CriteriaQuery"]),
    _r("JAVA-005", "JDBCConnectionInjection", "high", "java", "CWE-89", _A03, (r'DriverManager\.getConnection\s*\(\s*"[^"]*"\s*\+', "high"), (r'\.getConnection\s*\(\s*"[^"]*"\s*\+', "medium")),
    _r("JAVA-007", "InsecureTrustManager", "critical", "java", "CWE-295", _A02, (r"new\s+X509TrustManager\s*\(\s*\)\s*\{", "high"), (r"checkServerTrusted\s*\([^)]*\)\s*\{?\s*\}", "high")),
    _r("JAVA-010", "HostnameNotVerified", "high", "java", "CWE-297", _A02, (r"ALLOW_ALL_HOSTNAME_VERIFIER|NoopHostnameVerifier", "high"), (r"verify\s*\([^)]*\)\s*\{\s*return\s+true", "high")),
    _r("JAVA-011", "HardcodedJDBCCredentials", "high", "java", "CWE-798", _A07, (r'DriverManager\.getConnection\s*\(\s*"[^"]*"\s*,\s*"[^"]+"\s*,\s*"[^"]+"', "high")),
    _r("GO-001", "GORMSQLInjection", "critical", "go", "CWE-89", _A03, (r"\b(?:db|tx|gdb|gorm)\s*\.\s*(?:Raw|Exec|Where)\s*\(\s*fmt\.Sprintf\s*\(", "high"), (r"""\b(?:db|tx|gdb|gorm)\s*\.\s*(?:Raw|Exec)\s*\(\s*(?:"[^"]*"\s*\+|[a-zA-Z_]\w*\s*\+)""", "high")),
    _r("GO-002", "TemplateHTMLBypass", "high", "go", "CWE-79", _A03, (r"template\.(?:HTML|HTMLAttr|JS|CSS|URL)\s*\(", "medium"), line_none=["template\\.(?:HTML|HTMLAttr|JS|CSS|URL)\\s*\\(\\s*[\"`]"]),
    _r("GO-003", "ListenAndServeNoTLS", "medium", "go", "CWE-319", _A02, (r"\bhttp\.ListenAndServe\s*\(", "medium"), guards_none=[r"\bhttp\.ListenAndServeTLS\b", r"\btls\.Config\b"]),
    _r("GO-005", "FilepathTraversal", "high", "go", "CWE-22", _A01, (r"filepath\.Join\s*\(", "medium"), guards=[r"r\.(?:URL\.Query|FormValue|PostFormValue|Header\.Get|PathValue)\s*\(|mux\.Vars|chi\.URLParam|c\.(?:Param|Query|DefaultQuery|PostForm)"], near_none=[{"pattern": r"filepath\.Clean\s*\(|strings\.HasPrefix\s*\(", "before": 5, "after": 5}]),
    _r("GO-006", "MathRandCrypto", "high", "go", "CWE-338", _A02, (r"\brand\.(?:Read|Int|Intn|Int63|Int31|Float64|Float32|Uint32|Uint64|New|NewSource)\s*\(", "medium"), guards=['"math/rand"'], near=[{"pattern": r"(?i)(token|key|secret|nonce|salt|password|session|otp|csrf|iv|encrypt|cipher|sign|hmac|auth|credential)", "before": 5, "after": 5}]),
    _r("GO-009", "UnvalidatedRedirect", "high", "go", "CWE-601", _A01, (r"http\.Redirect\s*\(\s*\w+\s*,\s*\w+\s*,\s*r\.(?:URL\.Query\(\)\.Get|FormValue|PostFormValue|Header\.Get)\s*\(", "high"), (r"c\.Redirect\s*\(\s*\d+\s*,\s*c\.(?:Query|Param|PostForm|DefaultQuery|GetHeader)\s*\(", "high")),
    _r("GO-012", "PermissiveFileMode", "medium", "go", "CWE-732", _A01, (r"os\.Mkdir(?:All)?\s*\([^,]+,\s*0o?777\s*\)", "high"), (r"os\.(?:WriteFile|OpenFile)\s*\([^,]+,[^,]+,\s*0o?(?:777|766|776)\s*\)", "high")),
    _r("GO-013", "TrustedProxyMisconfig", "medium", "go", "CWE-348", _A05, (r"\.SetTrustedProxies\s*\(\s*nil\s*\)", "high"), (r"\.ForwardedByClientIP\s*=\s*true", "medium")),
    _r("PY-019", "DjangoRawSQL", "high", "python", "CWE-89", _A03, (r"""\.raw\s*\(\s*(?:f["']|["'][^"']*["']\s*%\s*[(\w]|["'][^"']*["']\s*\.format\s*\()""", "high"), (r"\.extra\s*\(\s*(?:where|select|tables)\s*=", "medium"), (r"""RawSQL\s*\(\s*(?:f["']|["'][^"']*["']\s*%)""", "high")),
    _r("PY-006", "AssertSecurity", "high", "python", "CWE-617", "A04:2021", (r"\bassert\b\s+(?:password|token|secret|api_key|session|role|permission|credential)\b", "medium")),
    _r("PY-015", "JWTNoVerification", "critical", "python", "CWE-347", _A02, (r"""jwt\.decode\s*\([^)]*(?:verify\s*=\s*False|options\s*=\s*\{[^}]*"verify_signature"\s*:\s*False)""", "high"), (r"""jwt\.decode\s*\([^)]*algorithms\s*=\s*\[?\s*["']none["']""", "high")),
]

_WEB = "go python javascript typescript java php ruby csharp"

# Ids, severities, languages, weaknesses and patterns of the injection and deserialization rules; a pattern may hold for one language and have a severity of its own.
RULES += [
    _r(
        "INJ-001", "SQL Injection", "critical", _WEB, "CWE-89", _A03,
        (r'(?i)fmt\.Sprintf\(\s*"[^"]*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"]*%[svdq]', "high", "go"),
        (r'(?i)(?:"[^"]*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"]*"\s*\+|\+\s*"[^"]*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b)', "high"),
        (r"""(?i)f["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"']*\{""", "high", "python"),
        (r"""(?i)["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"']*["']\s*%\s*[(\w]""", "high", "python"),
        (r"""(?i)["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"']*["']\s*\.format\(""", "high", "python"),
        (r"""(?i)(?:cursor|conn|connection|db)\s*\.\s*execute\(\s*(?:f["']|["'][^"']*["']\s*%|["'][^"']*["']\s*\.format|[^"',)]+\+)""", "high", "python"),
        (r"""(?i)["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"']*["']\s*\+\s*\w""", "high"),
        (r"""(?i)\.(?:query|execute|exec|prepare)\(\s*["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"']*["']\s*\+""", "high"),
        (r"(?i)`[^`]*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^`]*\$\{", "high"),
        (r'(?i)"[^"]*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"]*\$\w+', "medium", "php"),
        (r'(?i)"[^"]*\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|FROM|WHERE|SET|INTO|VALUES)\b[^"]*#\{', "medium", "ruby"),
        (r'(?i)\.where\(\s*"[^"]*#\{', "high", "ruby"),
    ),
    _r(
        "INJ-002", "Command Injection", "critical", _WEB + " shell", "CWE-78", _A03,
        (r"""(?i)\bos\.(system|popen|popen2|popen3|popen4)\s*\((?:\s*f["']|[^)"']*\+|[^)"']*%|.*\.format\()""", "high"),
        (r"(?i)\bsubprocess\.(call|run|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True", "high"),
        (r"""(?i)\bexec\.Command(?:Context)?\(\s*["'](?:sh|bash|cmd|/bin/sh|/bin/bash|cmd\.exe)["']\s*,\s*["']-c["']""", "high"),
        (r"""(?i)\bexec\.Command(?:Context)?\(\s*[^"'\s)][^,)]*[+]""", "medium"),
        (r"""(?i)\b(?:child_process\s*\.\s*)?(?:exec|execSync|spawn|spawnSync)\s*\(\s*(?:`[^`]*\$\{|[^"'\x60\s,)]+\s*[+]|f?["'][^"']*["']\s*\+)""", "high"),
        (r"""(?i)require\(\s*["']child_process["']\s*\)\s*\.exec\s*\(""", "medium"),
        *[(r"(?i)(?:`[^`]*\$[{(]|\$\([^)]*\$[{(])", "high", lang) for lang in "go python java php ruby shell csharp".split()],
        (r"""(?i)\bRuntime\s*\.\s*getRuntime\s*\(\s*\)\s*\.exec\s*\(\s*(?:["'][^"']*["']\s*\+|\w+[^"')]+\+)""", "high"),
        (r"(?i)\bnew\s+ProcessBuilder\s*\(", "low"),
        (r"(?i)\b(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\(\s*\$", "high"),
        (r"""(?i)(?:\b(?:system|exec|%x)\s*\(\s*["'][^"']*#\{|`[^`]*#\{)""", "high"),
        (r"""(?i)\bsubprocess\.(call|run|Popen|check_output|check_call)\s*\(\s*f?["']""", "medium"),
    ),
    _r(
        "INJ-004", "LDAP Injection", "high", _WEB, "CWE-90", _A03,
        (r"""(?i)(?:["']\s*\(\s*(?:&|\|)\s*\(\s*\w+\s*=\s*["']\s*\+|["']\(\w+=["']\s*\+)""", "high"),
        (r"""(?i)(?:ldap|ldap3|python-ldap)\S*\.\s*(?:search|search_s|search_ext|search_ext_s|bind)\s*\([^)]*(?:\+|%[sv]|\.format\(|f["'])""", "high"),
        (r"""(?i)(?:search_filter|ldap_filter|filter)\s*=\s*(?:f["'][^"']*\{|["'][^"']*["']\s*[+%]|["'][^"']*["']\s*\.format)""", "medium"),
    ),
    _r(
        "INJ-005", "Server-Side Template Injection", "high", "go python javascript typescript java php ruby", "CWE-1336", _A03,
        (r"""(?i)\brender_template_string\s*\(\s*[^"'\s)]""", "high"),
        (r"""(?i)\b(?:Template|Jinja2)\s*\(\s*(?:[^"'\s)][^)]*|f["']|["'][^"']*["']\s*[+%]|["'][^"']*["']\s*\.format)""", "medium"),
        (r"""(?i)\.from_string\s*\(\s*[^"'\s)]""", "high"),
        (r"""(?i)(?:ejs|pug|nunjucks|handlebars|mustache)\s*\.\s*(?:render|compile|renderString)\s*\(\s*[^"'\s)]""", "high"),
        (r"(?i)\$(?:twig|blade|smarty)\s*->\s*(?:render|display|createTemplate)\s*\(\s*\$", "high"),
        (r"""(?i)\bERB\.new\s*\(\s*[^"'\s)]""", "high"),
        (r"""(?i)(?:template|tmpl|tpl)(?:\.[^.]*)*\.\s*Parse\s*\(\s*[^"'`\s)]""", "medium"),
        (r"""(?i)(?:templateEngine|template|engine)\s*\.\s*(?:process|evaluate|merge)\s*\(\s*[^"'\s)]""", "medium"),
    ),
    _r(
        "INJ-006", "XPath Injection", "medium", _WEB, "CWE-643", _A03,
        (r"""(?i)(?:xpath|selectNodes|selectSingleNode|evaluate|querySelector)\s*\(\s*(?:"[^"]*"|'[^']*')\s*\+""", "high"),
        (r"""(?i)(?:xpath|selectNodes|selectSingleNode|evaluate)\s*\(\s*(?:f["']|.*\.format\(|fmt\.Sprintf)""", "high"),
        (r"""(?i)(?:xpath_expr|xpath_query|xpath_string)\s*=\s*(?:f["'][^"']*\{|["'][^"']*["']\s*[+%]|["'][^"']*["']\s*\.format)""", "high"),
        (r"""(?i)["'][^"']*(?://|/)\w+\s*\[\s*@?\w+\s*=\s*["']\s*\+""", "medium"),
    ),
    _r(
        "XXE-002", "JavaScriptXXE", "high", "javascript typescript", "CWE-611", _A05,
        (r"\blibxml(?:js)?\s*\.\s*parseXml\s*\([^)]*\bnoent\s*:\s*true", "high", "", "critical"),
        (r"(?:parse(?:Xml|XML|String)?|parseFromString)\s*\(\s*(?:req\s*\.\s*(?:body|query|params)|request\s*\.\s*(?:body|input))", "high", "", "high"),
        (r"\bnew\s+DOMParser\s*\(\s*\)", "medium", "", "medium"),
        (r"\bnew\s+(?:XMLParser|FastXMLParser)\s*\([^)]*\bprocessEntities\s*:\s*true", "high", "", "high"),
    ),
    _r(
        "DESER-001", "ExtendedDeserialization", "critical", "python java csharp", "CWE-502", _A08,
        (r"\bshelve\.open\s*\(", "high", "python"),
        (r"\bmarshal\.loads?\s*\(", "high", "python"),
        (r"\bXStream\s*\(\s*\)|\.fromXML\s*\(", "high", "java"),
        (r"\b(?:kryo|Kryo)\s*\.\s*(?:readObject|readClassAndObject)\s*\(", "high", "java", "high"),
        (r"\bnew\s+XMLDecoder\s*\(", "high", "java"),
        (r"\b(?:BinaryFormatter|LosFormatter|SoapFormatter|NetDataContractSerializer|ObjectStateFormatter)\s*\(", "high", "csharp"),
        (r"(?i)TypeNameHandling\s*[=:]\s*(?:TypeNameHandling\.)?(?:All|Auto|Objects|Arrays)", "high", "csharp", "high"),
    ),
    _r(
        "DESER-003", "PHPDangerousPatterns", "critical", "php", "CWE-94", _A03,
        (r"""\bpreg_replace\s*\(\s*['"][^'"]*\/e['"imsxuADSUXJ]*['"]""", "high"),
        (r"\bextract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)", "high"),
        (r"\bassert\s*\(\s*\$", "high"),
        (r"\bcreate_function\s*\(", "high"),
        (r"\$\$\w+\s*\(", "high"),
    ),
]

# Rules of our own, under ids of our own.
OWN_RULES = [
    _r("OWN-INJ-01", "SQLConcatenation", "critical", "*", "CWE-89", _A03, (r"""(?i)["'`]\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"'`]*["'`]\s*(?:\+|\.)\s*[$\w]""", "medium"), (r"(?i)`\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^`]*\$\{", "medium"), (r"""(?i)\bf["']\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*\{""", "medium")),
    _r("OWN-INJ-02", "ShellCommand", "critical", "python php ruby c javascript typescript", "CWE-78", _A03, (r"\b(?:os\.system|os\.popen|shell_exec|passthru|popen)\s*\(\s*[^\"'\s)]", "medium")),
    _r("OWN-XSS-01", "UnescapedOutput", "high", "javascript typescript", "CWE-79", _A03, (r"\.innerHTML\s*=\s*[^\"'`\s]", "medium"), (r"document\.write\s*\(\s*[^\"'`)]", "medium"), line_none=[r"DOMPurify|escapeHtml|sanitize"]),
    _r("OWN-TRV-01", "FilePathConcatenation", "high", "javascript typescript", "CWE-22", _A01, (r"""fs\.(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream)\s*\(\s*["'][^"']*["']\s*\+""", "medium"), near_none=[{"pattern": r"path\.(?:basename|normalize)", "before": 5, "after": 0}]),
    _r("OWN-CORS-01", "CORSWildcard", "medium", "*", "CWE-942", _A05, (r"""(?i)Access-Control-Allow-Origin["']?\s*[,:]\s*["']\*["']""", "high")),
    _r("OWN-LOG-01", "SecretInLog", "medium", "*", "CWE-532", "A09:2021", (r"(?i)\b(?:log|logger|logging|console)\.\w+\s*\([^)]*\b(?:password|passwd|secret|api_key|token)\b", "medium")),
    _r("OWN-MISC-01", "TodoSecurity", "info", "*", "CWE-546", "", (r"(?i)\b(?:TODO|FIXME|HACK)\b.*\b(?:check|security|auth|saniti[sz]e|validate)\b", "low"), comments=True),
]
RULES += OWN_RULES
