"""What the shipped rules say beside what they match: why a class of weaknesses matters, what to do, and where to read on."""

from __future__ import annotations

# category: (rationale, fix, classes of the OWASP Top Ten of 2021)
TEXTS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "injection": ("Text from outside becomes part of a statement that another program interprets, so whoever sends it decides what is run.", "Pass values as parameters of the interface (bound variables, argument lists) instead of building the statement from text.", ("A03:2021",)),
    "command-injection": ("A shell splits and expands the text it is given; input in it can start programs of the sender's choice.", "Call the program with a list of arguments and without a shell, and allow only known values.", ("A03:2021",)),
    "security-misconfiguration": ("A setting that helps during development, or a default that was left as it is, opens the running service.", "Set the value for production explicitly, and read it from the environment of the deployment.", ("A05:2021",)),
    "misconfiguration": ("A missing attribute leaves the browser with its permissive default.", "State the restrictive attribute for each such element.", ("A05:2021",)),
    "cryptography": ("The algorithm, mode or source of randomness is broken or predictable, so what it should protect can be read or forged.", "Use a current primitive of the platform's library (AES-GCM, SHA-256 or better, a cryptographic random source) with its defaults.", ("A02:2021",)),
    "path-traversal": ("A path made from input can climb out of its folder and reach any file that the process can read or write.", "Resolve the path first and check that it is still below the intended folder, or map input to known names.", ("A01:2021",)),
    "ssrf": ("The server fetches an address that the sender chose, with the server's own place in the network and its credentials.", "Allow only known hosts and schemes, and resolve and check the address before the request.", ("A10:2021",)),
    "authentication": ("Who calls is not established, or the secret that should establish it can be had by others.", "Verify the caller with a maintained library, and keep secrets outside the source in a secret store.", ("A07:2021",)),
    "xss": ("Text from outside is put into a page as markup, so it can run as script with the rights of whoever views it.", "Set it as text, or escape it for the place where it stands; keep the escaping of the template engine on.", ("A03:2021",)),
    "deserialization": ("Reading objects from input can build types of the sender's choice and run their code.", "Use a data-only format such as JSON with a schema, or a loader that builds plain values only.", ("A08:2021",)),
    "open-redirect": ("A redirect to an address from input lends the site's name to any other one.", "Redirect to paths of the own site or to listed targets only.", ("A01:2021",)),
    "dangerous-functions": ("The function runs its argument as code, or hands control to it in another way.", "Do without it: parse the value, or choose among known operations by name.", ("A03:2021",)),
    "logging": ("What is written to the log can be read by more people than the data was meant for, or be forged by whoever sends it.", "Leave secrets out of the log, and encode line ends of what comes from outside.", ("A09:2021",)),
    "xxe": ("The parser resolves external entities, so a document can read files and call addresses in the server's name.", "Turn document types and external entities off in the parser.", ("A05:2021",)),
    "format-string": ("A format from input decides what is read and shown.", "Use a constant format, and pass input as its arguments.", ("A03:2021",)),
    "ssti": ("A template made from input is run by the template engine with access to the program's objects.", "Keep templates in files, and pass input as their variables only.", ("A03:2021",)),
    "error-handling": ("An error that is swallowed leaves the program in a state that nobody checked.", "Catch the errors that are expected, handle or log them, and let the others through.", ("A09:2021",)),
    "redos": ("Some inputs make the expression backtrack for an exponential time.", "Rewrite the expression without nested repetition, or use an engine with linear time.", ("A05:2021",)),
    "insecure-transport": ("The connection is not encrypted or not checked, so others on the way can read and change it.", "Use TLS with verification of the certificate.", ("A02:2021",)),
    "dangerous-patterns": ("The construct does not hold in every way the program may be run.", "Use an explicit check that cannot be turned off.", ("A04:2021",)),
    "race-condition": ("Between the check and the use another process can exchange what was checked.", "Use an interface that creates or opens in one step.", ("A04:2021",)),
    "supply-chain": ("Content from another server is used without a check that it is the intended one.", "Pin it by digest or version, and verify before use.", ("A08:2021",)),
    "sensitive-data": ("Personal or secret data ends where it is not protected.", "Store or send it encrypted, or not at all.", ("A02:2021",)),
}


def complete(rule: dict) -> dict:
    """A shipped rule with the texts of its category; fields that it has of its own stay."""
    why, fix, owasp = TEXTS.get(rule.get("category") or "", ("", "", ()))
    name = rule.get("name") or ""
    numbers = [c[4:] for c in rule.get("cwe") or [] if c.startswith("CWE-")]
    texts = {
        "message": f"{name}. {why}".strip(),
        "description": f"{name} in {rule.get('language')} code.",
        "rationale": why,
        "fix_suggestion": fix,
        "owasp": list(owasp),
        "references": [f"https://cwe.mitre.org/data/definitions/{n}.html" for n in numbers],
        "tags": [x for x in (rule.get("category"), rule.get("language")) if x],
    }
    return {k: v for k, v in texts.items() if v} | rule
