"""Labelled examples for the classifier of fixed messages (lower case, without punctuation); it generalises from their words."""

from __future__ import annotations

#: Error pages, block pages and notices that scripts are needed.
NOTICE = """
error 404 not found
404 page not found
http status 503 service unavailable
http error 500 internal server error
403 forbidden
502 bad gateway
504 gateway timeout
400 bad request
401 unauthorized
410 gone
429 too many requests
error code 404 message not found
something went wrong on our end
oops something went wrong please try again later
sorry an unexpected error occurred
we are sorry this page is not available
sorry the page you are looking for could not be found
the page you requested does not exist
the page you requested could not be located or displayed
the requested url was not found on this server
the requested resource is no longer available
the document has moved or was deleted
this site cannot be reached check the address and try again
err connection refused
err connection timed out
the connection was reset
your connection was interrupted
check your internet connection and reload the page
return to the home page
go back to the home page
access denied
access has been restricted or limited
the link may be broken or the page may have been removed or renamed
please disable your ad blocker and reload
you do not have permission to view or access this resource
you are not authorized to access this page on this server
your ip address has been blocked
sign in or log in again to continue
your session has expired please sign in again
login required to view this page
we have detected unusual traffic from your network
confirm that you are not a robot to continue
please verify that you are human
complete the captcha to continue
checking your browser before accessing the site
this process is automatic your browser will redirect shortly
please wait while your request is being verified
ray id request id incident id reference id
too many queries or requests in a short time slow down and retry
your request was blocked or refused by the firewall
the server was unable to complete your request
the server encountered an internal error or misconfiguration
the server is temporarily unable to service your request due to maintenance
the upstream host did not answer in time
if the problem persists contact the administrator
this website is undergoing scheduled maintenance and will be back shortly
the site is temporarily down we will be back soon
this content is not available in your region
we cannot seem to find what you are looking for
database connection failed
error establishing a database connection
could not load could not connect could not open
no free slot
fatal error uncaught exception cannot continue
warning include header inc failed to open stream no such file or directory in php on line
warning undefined variable undefined index in php on line
traceback most recent call last file app py line in module
keyerror typeerror valueerror nameerror attributeerror indexerror
nullpointerexception stack trace at line
syntax error unexpected token
nosuchkey nosuchobject nosuchbucket the specified key object or bucket does not exist
accessdenied
please enable javascript to view this page
you must have javascript enabled to use this site
you need to enable javascript to run this app
javascript is required
javascript is disabled or switched off in your browser
javascript must be switched on or turned on before this page or viewer can start
please turn javascript on in your browser settings and reload the page
this site requires javascript and cookies
this page or application needs scripts to load or work properly
enable scripts and cookies to proceed
allow scripts and cookies for this domain and refresh
your browser does not support scripts javascript or they are switched off
your browser is out of date or not supported and cannot display this page
please upgrade or update your browser and make sure that scripting is allowed
some features will not load or work without javascript
scripts may be blocked by your browser
loading please wait if nothing happens
cookies are disabled in your browser
noscript
seite nicht gefunden fehler 404
die angeforderte seite wurde nicht gefunden
die seite ist derzeit nicht erreichbar
zugriff verweigert
zur startseite
bitte aktivieren sie javascript um diese seite anzuzeigen
bitte aktivieren sie cookies in ihrem browser
ihr browser unterstützt kein javascript
page introuvable erreur 404
la page demandée est introuvable
retour à laccueil
accès refusé
contenu indisponible pour le moment
veuillez activer javascript pour afficher ce contenu
votre navigateur ne prend pas en charge javascript
página no encontrada error 404
la página solicitada no existe
volver al inicio
acceso denegado
contenido no disponible temporalmente
active javascript en su navegador para ver el contenido
su navegador no es compatible
""".strip().splitlines()
#: What a template says where real text is to be written.
FILLER = """
dummy text dummy paragraph dummy content dummy copy
dummy paragraph one two three
sample text example text
this is placeholder text or copy for this section and will be replaced before launch
placeholder content placeholder heading placeholder image
replace this paragraph with a description of the business
replace this text with your own content
add a short introduction or description of your company here in two or three sentences
your headline here your title here your text here your text goes here your tagline here
insert your text here type your text here write your text here enter your text here
click to edit double click to edit this text
click here to add text tap to add a title
content goes here content coming soon
text text text text text
asdf asdf asdf jkl jkl test test test
qwerty qwertz asdfgh
hier steht ein blindtext der später durch den endgültigen inhalt ersetzt wird
dies ist ein blindtext platzhalter
texte de remplissage faux texte texte factice texte provisoire
texto de relleno texto provisional texto ficticio
""".strip().splitlines()
#: Short lines around a page that are neither text nor notice.
NEUTRAL = """
home menu search login contact careers sitemap about
home about contact search
welcome to
all rights reserved copyright
published 12 jan feb mar apr may jun jul aug sep oct nov dec
back to search results
reference
privacy policy terms of use
""".strip().splitlines()
