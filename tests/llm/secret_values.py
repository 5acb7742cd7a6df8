"""Labelled values for the secret scan: random ones by rule, as services issue
them, and written ones that stand where a secret would but are none."""

import base64
import random
import string
import uuid

CODE = """
request.headers.get("Authorization")
config['database']['password']
HTTPBasicAuth(username
os.getenv("DB_PASSWORD")
os.environ["API_TOKEN"]
tokenizer.convert_tokens_to_ids(tok)
self.current_token.next_sibling
response.json()["access_token"]
settings.SECRET_KEY
process.env.STRIPE_SECRET_KEY
process.env.NEXT_PUBLIC_API_KEY
getpass.getpass("Password: ")
hashlib.sha256(data).hexdigest()
crypto.randomBytes(32).toString('hex')
secrets.token_urlsafe(32)
credentials.get_frozen_credentials()
session.get("csrf_token")
System.getenv("GITHUB_TOKEN")
ConfigurationManager.AppSettings["ApiKey"]
Environment.GetEnvironmentVariable("PASSWORD")
vault.read("secret/data/database")
this.props.authentication.token
user.encrypted_password
authenticationService.refreshToken
parser.lookahead_token
lexer.next_token()
new SecretKeySpec(keyBytes
ENV.fetch("RAILS_MASTER_KEY")
Rails.application.credentials.secret_key_base
boto3.Session().get_credentials()
bcrypt.hashpw(password
flask_bcrypt.generate_password_hash
jwt.encode(payload
kwargs.pop("password"
django.contrib.auth.hashers.make_password
input("Enter your password: ")
$_POST['password']
$request->input('password')
${DATABASE_PASSWORD}
${{ secrets.DEPLOY_TOKEN }}
{{ vault_database_password }}
$(cat /run/secrets/database_password)
$DB_PASSWORD
%(password)s
#{ENV['SECRET']}
<your-access-token-here>
<insert_api_key>
{password}
[REDACTED]
passwordField.getText()
document.getElementById("password").value
req.body.password
ctx.request.body.refresh_token
form.cleaned_data
widget.attrs.update
model.tokenizer.special_tokens
grammar.terminal_symbols
std::getenv("TOKEN")
context.Request.Headers
keyring.get_password("system"
""".strip().split("\n")
LINKS = """
https://example.com/oauth/authorize
https://auth.example.org/realms/main/protocol/openid-connect/token
http://localhost:8080/login
https://docs.example.com/guides/authentication
postgresql://localhost/database
https://api.example.com/v1/tokens
file:///etc/application/secrets
s3://company-bucket/secrets/production
""".strip().split("\n")
PROSE = """
Please enter your password to continue
The secret of good bread is time and patience
a token of appreciation from all of us
must be at least eight characters long
wrong password, please try again
not the one you used before
ask the administrator for the key
this field is required and must be unique
stored in the vault of the company
Votre mot de passe est obligatoire
Bitte geben Sie das Kennwort erneut ein
""".strip().split("\n")
PLACEHOLDERS = """
your_api_key_here
YOUR-SECRET-TOKEN
changeme
password123
replace_with_your_token
xxxxxxxxxxxxxxxx
****************
example_access_token
my_secret_password
insert-your-key-here
test_token_please_ignore
1234567890123456
aaaaaaaaaaaaaaaaaaaaaaaa
abcdefghijklmnopqrstuvwxyz
qwertyuiopasdfgh
00000000-0000-0000-0000-000000000000
client_secret_placeholder
dummy_value_for_tests
none_provided_by_default
database_connection_password
production_database_user
PersistentVolumeClaim
application_default_credentials
refresh_token_expiration_time
two_factor_authentication_required
2024-01-01
default_password_change_me
""".strip().split("\n")
HARMLESS = CODE + LINKS + PROSE + PLACEHOLDERS


def issued(seed: int = 7, each: int = 10) -> list[str]:
    rng = random.Random(seed)
    letters, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits

    def draw(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    out = []
    for _ in range(each):
        out += [
            draw(letters, 12),
            draw(letters, 16),
            draw(letters, 24),
            draw(letters + "!@#%^&*_-+", 14),
            draw(string.ascii_lowercase + string.digits, 20),
            draw("0123456789abcdef", 20),
            draw("0123456789abcdef", 32),
            draw(letters + "+/", 40),
            draw(upper, 20),
            base64.b64encode(rng.randbytes(24)).decode(),
            str(uuid.UUID(int=rng.getrandbits(128), version=4)),
            "-".join(draw(upper, 5) for _ in range(4)),
            "key_live_" + draw(letters, 24),
            ".".join(base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=") for n in (27, 60, 32)),
        ]
    return out
