"""Residue and content in wordings of our own, made without regard to how the test data are worded; recall and precision are measured on them."""

DIFF = "diff --git a/src/queue.py b/src/queue.py\nindex 11aa22b..33cc44d 100644\n--- a/src/queue.py\n+++ b/src/queue.py\n@@ -1,2 +1,2 @@\n-    return old\n+    return new\n"


def git(message, diff=DIFF):
    body = "\n".join("    " + x if x else "" for x in message.split("\n"))
    return f"commit 89abcdef01234567\nAuthor: Kim Lee <kim@lee.example>\nDate:   2021-02-03\n\n{body}\n\n{diff}"


def mail(subject, body="", diff=DIFF):
    return f"From 89abcdef01234567\nFrom: Kim <kim@lee.example>\nDate: 2021-02-03\nSubject: [PATCH] {subject}\n\n{body}\n---\n{diff}\n--\n"


RESIDUE = [
    # pages
    "Sorry, we could not find the page you requested.", "<html><body><h1>502 Bad Gateway</h1><hr>nginx</body></html>", "<!DOCTYPE html><html><head><title>Service unavailable</title></head><body>The service is temporarily unavailable. Please try again later.</body></html>",
    '{"code": 403, "message": "You do not have permission to view this repository"}', '{"error": {"status": 429, "detail": "Too many requests from your address"}}', "404\n\nThe file you are looking for is not here.", "500 Internal Server Error\n\nThe server could not answer your request.",
    "SomeForge\n\nHome | Explore | Help\n\nYou must sign in to see this project.\n\n(c) SomeForge 2021", "Access to this repository is forbidden.", "Your session has expired. Please sign in again.", "HTTP 504 Gateway Timeout. The upstream server took too long.", "This repository is private or has been removed.",
    '<?xml version="1.0"?><response><status>404</status><reason>Revision not found</reason></response>', "Too many requests from this network. Please wait a few minutes and try again.",
    # scripts
    "Please enable JavaScript to view this page.", "<html><body><noscript>You need to enable JavaScript to run this app.</noscript></body></html>", "JavaScript is disabled in your browser. Switch it on and reload the page.", "This site requires JavaScript and cookies to be enabled.", "SomeView - loading ...\n\nThis page needs scripts to show the diff.",
    # instead of a diff
    git("Speed up the queue\n\nIt was slow.", "Error 500 while loading the diff: the server did not respond"), git("Speed up the queue", "<html><body>You need to sign in to see these changes.</body></html>"), mail("Speed up the queue", "It was slow.", "Please enable JavaScript to see the changes."), git("Speed up the queue", '{"status": 503, "error": "The service is unavailable"}'), git("Speed up the queue", "{{ diff }}"),
    # unfilled
    git("{{ commit_title }}\n\n{{ commit_body }}"), git("Release v${version}"), git("${type}(${scope}): ${subject}"), git("Merge pull request #<%= number %> from %(branch)s"), git("fix(None): undefined"), mail("<title>", "<body>"), git("[[summary]]\n\nReviewed-by: [[reviewer]]"), git("Bump {package} from {old} to {new}"), git("null\n\nnull"), '{"repo": "a/b", "sha": "1", "message": "#{title}", "patch": ""}',
    # instructions
    git("<Describe your change in one sentence>\n\n<Explain why it is needed>"), git("[Insert a short title here]"), git("___Enter summary___"), git("{a short summary of the change}\n\n{how it was tested}"), mail("<what does this change do>", "[add the reason here]"), git("*Describe the change*\n\n(explain why)"), git("TODO: write a title\n\nTODO: explain the reason"),
    # filler
    git("Lorem ipsum dolor sit amet\n\nConsectetur adipiscing elit, sed do eiusmod tempor."), git("foo foo foo foo"), git("blah blah blah\n\nblah blah blah blah blah"), git("asdf asdf qwer\n\nzxcv asdf qwerty uiop"), git("xx xx xx xx xx xx"), git("Placeholder text.\n\nThis is placeholder text."), git("test test test\n\ntest test test test"), mail("Dummy text", "Dummy text. More dummy text."),
]

CONTENT = [
    git("Show a friendlier text when the page was not found"), git("Return 503 instead of 500 when the backend is down\n\nThe old code answered 'Internal server error' to every caller."), git("Make JavaScript optional on the start page"), git("Fix crash when the session has expired\n\nUsers saw \"Your session has expired\" twice."), git("Replace lorem ipsum in the demo with real text"), git("Remove placeholder text from the header\n\nIt still said 'Placeholder text' on phones."),
    git("Allow {{ name }} in mail templates"), git("Keep ${HOME} as it is when it is quoted"), git("Handle undefined titles"), git("Do not write null into the log\n\nThe nightly job wrote null for every row."), git("Add a template for commit messages\n\nIt asks to describe the change and to explain why."), git("Rename <Header> to <TopBar>"), git("[parser] Skip empty lines"), git("(re)use the connection of the pool"), git("Update README"), git("wip"), git("typo", ""), git("fix"), git("Merge branch 'main' into fix/queue"),
    git("Merge pull request #12 from kim/queue\n\nSpeed up the queue", ""), git("Bump left-pad from 1.2.0 to 1.3.0"), git("Release 3.2.1"), git("v2.0.0"), git("chore: release"), git("Nightly build 20210203"), git("Revert \"Speed up the queue\"\n\nThis broke the export."), "fix tests", "Merge branch 'main' into fix/queue", "Speed up the queue\n\nThe lock was held for too long.", "Release notes for 2.4\n\nThe parser was rewritten. The loader is faster.",
    mail("Retry the call when the server took too long", "Without this the import stops with 504."), mail("docs: describe how to write a summary"), mail("Document the error page", "The page says that the project is private or was removed."), git("Behebt einen Fehler beim Laden der Liste"), git("Corrige la carga de la tabla"), git("Ajoute un test pour le chargement"), git("Show \"404 Not found\" in the title"), git("Log of the failed run:\n  500 Internal Server Error\n  500 Internal Server Error"), '{"repo": "a/b", "sha": "1", "message": "Speed up the queue", "patch": ""}', git("Fix the title of the error page\n\nIt was 'Not found' for every status."),
    git("Speed up the queue", "Binary files a/x.png and b/x.png differ"), git("test: cover the gateway timeout"), git("Sign in again after the token has expired"), git("Enable scripts in the build only when asked"), git("Drop the 'coming soon' text"), git("Add test data\n\nfoo, bar and baz are the users of the test."), git("CRLF to LF"), git("Reformat"), git("More work on the queue"), git("Address review comments"),
]

#: A second set, written after the rules were final and measured once; nothing was changed for it.
LAST_RESIDUE = [
    "Oops! That branch does not exist.", "The requested URL was not found on this server.", "403 Forbidden\n\nYou may not look at this commit.", "Service is under maintenance, please come back in an hour.", '{"status": "error", "message": "The project could not be found"}', "<html><head><title>Error 500</title></head><body><p>Something went wrong on the server.</p></body></html>",
    "OtherHub\n\nExplore | Help | Sign in\n\nThis commit is not available any more.\n\n(c) OtherHub 2022", "Your browser does not run scripts, so nothing can be shown.", "<div>Please allow JavaScript for this site.</div>", "You need JavaScript to browse the changes.", mail("Sort the list of keys", "The order was random.", "Error 404: the patch could not be found"), git("Sort the list of keys", "JavaScript must be enabled to load the diff."), git("Sort the list of keys", "<p>Sign in to see the diff</p>"),
    git("<%= title %>\n\n<%= body %>"), git("Release %(version)s\n\n%(notes)s"), mail("{SUBJECT}", "{DESCRIPTION}"), git("undefined: undefined"), git("Merge branch '${source}' into ${target}"), git("<Short title of the change>\n\n<Reason>"), git("[describe what was done]\n\n[describe how it was tested]"), git("Enter a title here\n\n- [explain the reason]"), git("lorem ipsum dolor sit amet consectetur"), git("text text text text\n\ntext text text"), git("jkl jkl asd asd\n\nqwe rty uio"),
]
LAST_CONTENT = [
    git("Return 404 for branches that do not exist"), git("Explain in the help why scripts are needed"), git("Log the error when the server is down\n\nSo far it was lost."), git("Quote the title in the mail"), git("Use %(name)s instead of %s in messages"), git("Fix {title} not being replaced"), git("Move the sign in button"), git("Test the case of an empty message"), git("Do not crash on undefined values"), git("Describe the options in the manual"), git("Add missing translations"), git("bump version"), git("oops"), git("cleanup", ""), "more fixes", "Merge tag 'v1.2'", "Rename the module\n\nThe old name was too long.",
    mail("Make the summary shorter"), mail("Stop after three retries", "The gateway answers 502 for minutes."), git("Corrige el orden de las claves"), git("Sortiert die Liste der Namen neu"), git("Say \"not found\" only once"), '{"repo": "a/b", "sha": "2", "message": "Sort the list of keys", "patch": ""}', git("Remove dummy users from the demo"),
]
